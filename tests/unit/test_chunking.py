from lodestack.operators import chunking as c


def test_headings_cut_and_stack():
    p = c.markdown("# A\ntext\n## B\nmore\n# C\nend")
    assert [x.hierarchy for x in p] == [["A"], ["A", "B"], ["C"]]
    assert [x.offset for x in p] == [0, 9, 19]
    assert c.heading("####### deep") == (7, "deep") and c.heading("#no") is None and c.heading("#") is None


def test_fences_stay_whole():
    text = "# A\n```\n# not a heading\n\nx\n```\nafter"
    assert len(c.markdown(text)) == 1
    assert [x[0] for x in c.paragraphs("a\n\n```\nb\n\nc\n```\n\nd")] == ["a\n\n```\nb\n\nc\n```", "\nd"]  # an opening fence is no boundary
    assert [x[0] for x in c.paragraphs("a\n\n\nb\n")] == ["a", "\n\nb\n"]


def test_large_section_is_packed_and_large_paragraph_stays():
    part = "word " * 30
    got = c.markdown("# T\n" + "\n\n".join([part] * 6), 100)
    assert len(got) > 1 and all(c.tokens(x.content) <= 110 for x in got)
    assert len(c.markdown("# T\n" + "x" * 4000, 100)) == 1
    assert c.markdown("") == [] and len(c.markdown("no heading")) == 1


def test_plain_text_lines_and_limits():
    got = c.plain("\n".join(["a" * 30] * 10), 20)
    assert [x.lines for x in got][0] == (1, 3) and "".join(x.content.replace("\n", "") for x in got) == "a" * 300
    assert c.plain("") == []
    assert [x.content for x in c.plain("a" * 50 + "\n\n" + "b", 20)] == ["a" * 50, "\nb"]


def test_rust():
    src = "use std::fmt;\n\n/// doc\n#[derive(Debug)]\npub struct P {\n    x: i32,\n}\n\npub fn f<'a>(\n    s: &'a str,\n) -> i32 {\n    let c = '{';\n    1\n}\n\nimpl fmt::Display for P {\n    fn g(&self) {}\n}\n\npub const N: i32 = 3;\n"
    p = c.chunks_of("m.rs", src)
    assert [x.symbol for x in p] == ["<prelude>", "struct P", "fn f", "impl fmt::Display for P", "const N"]
    assert [x.lines for x in p] == [(1, 1), (3, 7), (9, 14), (16, 18), (20, 20)]
    assert p[2].signature.startswith("pub fn f<'a>(")


def test_python_drops_later_loose_lines():
    p = c.chunks_of("m.py", "import x\n\n@dec\ndef f():\n    return 1\n\nX = 3\n\nclass A:\n    def g(self):\n        pass\n")
    assert [x.symbol for x in p] == ["<prelude>", "def f", "class A"]
    assert p[1].content.startswith("@dec") and "X = 3" not in "".join(x.content for x in p)


def test_go_typescript_and_others():
    go = c.chunks_of("a.go", "package a\n\nimport (\n\t\"fmt\"\n)\n\nconst (\n\tA = 1\n)\n\nfunc (s T) M(\n\ta int,\n) int {\n\treturn 1\n}\n")
    assert [x.symbol for x in go] == ["<prelude>", "import (block)", "const (block)", "func (*T).M"]
    ts = c.chunks_of("a.ts", "import x from 'y';\n\nexport interface A {\n  b: string;\n}\n\nexport async function f(\n  a: number,\n): Promise<void> {\n  const s = '}';\n}\n\nexport class C {\n  m() {}\n}\n")
    assert [x.symbol for x in ts][1:] == ["interface A", "function f", "class C"]
    for path, src, want in [
        ("a.java", "package p;\n\npublic class A {\n  void f() {}\n}\n", "class A"), ("a.kt", "fun f() {\n}\n\nclass K {\n}\n", "class K"), ("a.php", "<?php\nfunction f() {\n}\n", "function f"),
        ("a.rb", "class A\n  def f\n  end\nend\n", "class A"), ("a.swift", "struct S {\n}\n", "struct S"), ("a.zig", "pub fn f() void {\n}\n", "fn f"), ("a.c", "int main(void) {\n  return 0;\n}\n", "function main"), ("a.cpp", "class K {\n};\n", "class K"),
    ]:
        p = c.chunks_of(path, src)
        assert want in [x.symbol for x in p], (path, [x.symbol for x in p])


def test_large_item_in_parts_and_fallback():
    body = "\n\n".join(f"    let a{i} = {i};" for i in range(200))
    p = c.chunks_of("m.rs", f"fn big() {{\n{body}\n}}\n", 100)
    assert len(p) > 1 and p[0].symbol == "fn big (part 1)"
    assert c.chunks_of("m.rs", "just words\n")[0].language is None


def test_table_function(spark):
    df = spark.createDataFrame([("a.md", "# A\nx"), ("b.txt", "y"), ("c.rs", "fn f() {}\n"), ("d.md", None)], "path string, content string")
    got = {r.id: r for r in c.chunk(df).collect()}
    assert set(got) == {"a.md:0", "b.txt:0", "c.rs:0"} and got["c.rs:0"].line_range.start == 1 and got["a.md:0"].heading_hierarchy == ["A"]
    whole = c.reassemble(c.chunk(spark.createDataFrame([("r.md", "# Intro\nHello world\n# Usage\nUse it well")], "path string, content string"))).first()
    assert whole.content == "# Intro\nHello world\n# Usage\nUse it well"


def test_conversation(spark):
    m = spark.createDataFrame([("s", 0, "user", "hé"), ("s", 1, "assistant", "b")], "source_id string, turn_index int, role string, content string")
    rows = c.conversation(m, wing="w", room="r").orderBy("chunk_index").collect()
    assert rows[0].content == "[turn:0][role:user]\nhé" and rows[1].byte_offset == rows[0].byte_length + 1
    assert rows[0].heading_hierarchy == ["conversation", "w", "r"] and rows[0].symbol == "r" and rows[0].signature is None


def test_doc_section():
    assert c.doc_section("# A\na\n## B\nb\n# C\nc\n# A\nz", "A") == "# A\na\n## B\nb\n# A\nz"


def test_plain_text_is_cut_at_line_ends_only():
    from lodestack.operators import chunking

    text = "a\x0cb c\r\nd\x85e\n"
    (one,) = chunking.plain(text)
    assert one.content == "a\x0cb c\nd\x85e" and one.lines == (1, 2)
