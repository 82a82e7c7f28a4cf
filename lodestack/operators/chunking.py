"""Chunkers as table functions: one document in, many chunk rows out.

The rules that look back at earlier lines (open fences, heading stacks, brace depth) run in Python over whole documents, in Arrow batches; transcripts
are chunked in SQL alone."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCHEMA = "id string, source_path string, heading_hierarchy array<string>, chunk_index int, byte_offset long, byte_length int, content_hash string, content string, language string, symbol string, signature string, line_range struct<start:int,end:int>"
MAX_TOKENS = 512


def tokens(text: str) -> int:
    return -(-len(text.encode()) // 4)


@dataclass
class Piece:
    content: str
    offset: int = 0
    hierarchy: list[str] = field(default_factory=list)
    language: str | None = None
    symbol: str | None = None
    signature: str | None = None
    lines: tuple[int, int] | None = None


def heading(line: str) -> tuple[int, str] | None:
    """(number of '#', title); any number of them counts."""
    m = re.fullmatch(r"\s*(#+)( .*)?", line.rstrip("\r\n"), re.S)
    title = (m.group(2) or "").strip() if m else ""
    return (len(m.group(1)), title) if m and title else None


def fence(line: str) -> bool:
    return line.lstrip().startswith("```")


def paragraphs(text: str) -> list[tuple[str, int]]:
    """(text, byte offset) of parts between blank lines outside of fences; blank lines stay before the part they precede."""
    out: list[tuple[str, int]] = []
    part: list[str] = []
    begin = at = 0
    open_ = False
    for line in text.split("\n"):
        if fence(line):
            open_ = not open_
        blank = not line.strip()
        if not part:
            begin = at
        elif not open_ and not blank and not part[-1].strip():
            keep = len(part)
            while keep and not part[keep - 1].strip():
                keep -= 1
            if keep:
                out.append(("\n".join(part[:keep]), begin))
                part = part[keep:]
                begin = at
        part.append(line)
        at += len(line.encode()) + 1
    return [*out, ("\n".join(part), begin)] if part else out


def markdown(content: str, most: int = MAX_TOKENS) -> list[Piece]:
    """Sections at headings outside of fences; a section over ``most`` tokens is packed from paragraphs, of which one too large stays whole."""
    sections: list[tuple[list[str], list[str], int]] = []
    stack: list[tuple[int, str]] = []
    at, open_ = 0, False
    for line in content.split("\n"):
        if fence(line):
            open_ = not open_
        h = None if open_ else heading(line)
        if h:
            stack = [x for x in _below(stack, h[0])] + [h]
        if h or not sections:
            sections.append(([t for _, t in stack], [], at))
        sections[-1][1].append(line)
        at += len(line.encode()) + 1
    out = []
    for titles, lines, start in sections:
        text = "\n".join(lines)
        if not text.strip():
            continue
        if tokens(text) <= most:
            out.append(Piece(text, start, titles))
            continue
        pack: list[str] = []
        begin = start
        for p, o in paragraphs(text):
            if pack and tokens("\n\n".join([*pack, p])) > most:
                out.append(Piece("\n\n".join(pack), begin, titles))
                pack = []
            if not pack:
                begin = start + o
            pack.append(p)
        if pack:
            out.append(Piece("\n\n".join(pack), begin, titles))
    return out


def _below(stack: list[tuple[int, str]], level: int) -> list[tuple[int, str]]:
    while stack and stack[-1][0] >= level:
        stack = stack[:-1]
    return stack


def _lines(content: str) -> list[str]:
    """Cut at line ends only, without their returns; a line end at the end of the text begins no line."""
    lines = [x.removesuffix("\r") for x in content.split("\n")]
    return lines[:-1] if lines[-1] == "" else lines


def plain(content: str, most: int = MAX_TOKENS) -> list[Piece]:
    """Lines packed to 4 * most bytes; a blank line ends a chunk that is half full."""
    limit, out, part, size, first = most * 4, [], [], 0, 1
    for n, line in enumerate(_lines(content), 1):
        length = len(line.encode()) + 1
        if part and not line.strip() and size * 2 >= limit:
            out.append(Piece("\n".join(part).rstrip(), lines=(first, n)))
            part, size, first = [], 0, n + 1
        elif part and size + length > limit:
            out.append(Piece("\n".join(part).rstrip(), lines=(first, n)))
            part, size, first = [], 0, n
        part.append(line)
        size += length
    if part:
        out.append(Piece("\n".join(part).rstrip(), lines=(first, first + len(part) - 1)))
    return out


def split_blank(text: str, limit: int) -> list[str]:
    """Cuts at blank lines once half of ``limit`` bytes are held."""
    out, part = [], []
    for line in text.split("\n"):
        if part and not line.strip() and 2 * len("\n".join(part).encode()) >= limit:
            out.append("\n".join(part).rstrip())
            part = []
        part.append(line)
    return [*out, "\n".join(part).rstrip()] if "\n".join(part).strip() else out


# --- code ---------------------------------------------------------------------------------------------------------------

# How top-level items begin in each language; group 1 is the kind, group 2 the name.
_MOD = r"(?:pub(?:\([^)]*\))?\s+)?(?:default\s+)?(?:async\s+)?(?:const\s+)?(?:unsafe\s+)?(?:extern\s+\"[^\"]*\"\s+)?"
ITEMS = {
    "rust": [rf"{_MOD}(fn|struct|enum|trait|mod|type|union|static|const)\s+(\w+)", rf"{_MOD}(impl)\b\s*(?:<[^{{]*?>\s*)?([^{{]+)", r"(macro_rules)!\s*(\w+)"],
    "go": [r"(func)\s+(\([^)]*\)\s*\w+|\w+)", r"(type|var)\s+(\w+)", r"(const)\s+(\w+|\()", r"(import|var|type)\s*(\()", r"(import)\s+(\S+)"],
    "typescript": [r"(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(function|class|interface|enum|namespace)\*?\s*(\w+)?", r"(?:export\s+)?(?:declare\s+)?(type|const|let|var)\s+(\w+)"],
    "c": [r"(struct|enum|union|typedef)\b\s*(\w+)?", r"(?:[A-Za-z_][\w\s\*]*?)(\s)\**(\w+)\s*\([^;]*$"],
    "cpp": [r"(?:template\s*<[^>]*>\s*)?(class|struct|enum|union|namespace|typedef)\b\s*(?:class\s+)?(\w+)?", r"(?:[A-Za-z_][\w:\s\*&<>,~]*?)([\s])[\*&]*([\w:~]+)\s*\([^;]*$"],
    "java": [r"(?:@\w+\s+)*(?:(?:public|private|protected|abstract|final|static|sealed)\s+)*(class|interface|enum|record|@interface)\s+(\w+)"],
    "kotlin": [r"(?:(?:public|private|internal|open|abstract|sealed|data|inline|suspend|override)\s+)*(class|object|interface|fun|enum class|typealias)\s+(?:<[^>]*>\s*)?([\w.]+)"],
    "php": [r"(?:(?:abstract|final)\s+)?(class|interface|trait|function|enum)\s+(\w+)"],
    "swift": [r"(?:@\w+\s+)*(?:(?:public|private|internal|open|final|static)\s+)*(class|struct|enum|protocol|extension|func|actor)\s+(\w+)"],
    "zig": [r"(?:pub\s+)?(?:export\s+)?(fn|const|var)\s+(\w+)", r"(test)\s+(\"[^\"]*\"|\w+)"],
    "ruby": [r"(class|module|def)\s+([\w.:?!=]+)"],
    "python": [r"(?:async\s+)?(def|class)\s+(\w+)"],
}
ITEMS["javascript"] = ITEMS["tsx"] = ITEMS["typescript"]
EXTENSIONS = {"rs": "rust", "py": "python", "pyi": "python", "go": "go", "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "java": "java", "kt": "kotlin", "kts": "kotlin", "php": "php", "rb": "ruby", "swift": "swift", "zig": "zig"}


def code_only(line: str, language: str, in_comment: bool) -> tuple[str, bool]:
    """The line without strings, characters and comments, so that its braces can be counted; a lifetime such as 'a is text."""
    out, i, quotes = [], 0, "\"`" if language == "rust" else "\"'`"
    hash_comment = language in ("python", "ruby", "php")
    while i < len(line):
        if in_comment:
            j = line.find("*/", i)
            if j < 0:
                return "".join(out), True
            in_comment, i = False, j + 2
            continue
        c = line[i]
        if line.startswith("/*", i) and not hash_comment:
            in_comment, i = True, i + 2
        elif line.startswith("//", i) and language not in ("python", "ruby") or c == "#" and hash_comment:
            break
        elif c == "'" and language == "rust":
            m = re.match(r"'(\\.[^']*|[^\\'])'", line[i:])
            i += m.end() if m else 1
        elif c in quotes:
            j = i + 1
            while j < len(line) and line[j] != c:
                j += 2 if line[j] == "\\" else 1
            i = j + 1
        else:
            out.append(c)
            i += 1
    return "".join(out), in_comment


def _begin(line: str, language: str) -> tuple[str, str] | None:
    if not line or line[0].isspace() or line.startswith(("//", "#include", "/*", "*")):
        return None
    for p in ITEMS[language]:
        m = re.match(p, line)
        if m:
            kind, name = m.group(1).strip() or "function", (m.group(2) or "").strip()
            if language == "go" and kind == "func" and name.startswith("("):
                r, method = re.fullmatch(r"\(([^)]*)\)\s*(\w+)", name).groups()
                return kind, f"(*{r.split()[-1].lstrip('*').split('[')[0]}).{method}" if r.split() else method
            if name == "(":
                return kind, "(block)"
            if kind == "import":
                return kind, ""
            return kind, re.split(r"\s+where\b", name)[0].strip()
    return None


def _cut(text: str, item: tuple[str, str] | None, language: str, first: int, most: int) -> list[Piece]:
    """One chunk, or numbered parts of one that is too large."""
    symbol = "<prelude>" if item is None else " ".join(x for x in item if x)
    signature = next((x.strip().rstrip("{").strip() for x in text.split("\n") if x.strip() and not x.lstrip().startswith(("@", "#[", "//", "/*", "*"))), "")
    if tokens(text) <= most:
        return [Piece(text, 0, [], language, symbol, signature, (first, first + text.count("\n")))]
    out, line = [], first
    for n, part in enumerate(split_blank(text, most * 4), 1):
        out.append(Piece(part, 0, [], language, f"{symbol} (part {n})", signature, (line, line + part.count("\n"))))
        line += part.count("\n") + 1
    return out


def code(content: str, language: str, most: int = MAX_TOKENS) -> list[Piece]:
    """Top-level items. An item of a brace language stays open until its braces (and, in Go, parentheses) are closed after the first one, or until
    a ';' at depth 0; of an indented language until the next line at column 0. Lines before the first item are the prelude; attributes, decorators and comments belong
    to the item below."""
    indented = language in ("python", "ruby")
    lines = content.split("\n")
    out: list[Piece] = []
    held: list[str] = []  # lines that may belong to the next item
    held_from = 1
    body: list[str] = []
    item: tuple[str, str] | None = None
    depth, opened, begin, comment, seen = 0, False, 1, False, False

    def close() -> None:
        nonlocal body, item
        while body and not body[-1].strip():
            body.pop()
        if body:
            out.extend(_cut("\n".join(body), item, language, begin, most))
        body, item = [], None

    for n, line in enumerate(lines, 1):
        bare, comment_next = code_only(line, language, comment)
        start = None if comment else _begin(line, language)
        if item is not None and indented:
            if not line.strip() or line[0].isspace() or line.startswith((")", "]", "}")) or (language == "ruby" and line.startswith("end")):
                body.append(line)
                comment = comment_next
                continue
            close()
        if item is None:
            if start:
                lead = []
                while held and re.match(r"\s*(@|#\[|#!\[|//|/\*|\*)", held[-1]):
                    lead.insert(0, held.pop())
                if held and any(x.strip() for x in held) and not seen:
                    text = "\n".join(held).rstrip()
                    out.extend(_cut(text, None, language, held_from, most))
                seen, held, item = True, [], start
                body, begin = lead, n - len(lead)
                depth, opened = 0, False
            else:
                if not held:
                    held_from = n
                held.append(line)
                comment = comment_next
                continue
        body.append(line)
        comment = comment_next
        if not indented:
            up, down = ("{(", "})") if language == "go" else ("{", "}")
            for c in bare:
                if c in up:
                    depth, opened = depth + 1, opened or c == "{" or item[1] == "(block)" or item[0] == "import"
                elif c in down:
                    depth -= 1
            ended = opened and depth <= 0 or depth <= 0 and bare.rstrip().endswith(";")
            if language in ("go", "kotlin", "swift", "typescript", "tsx", "javascript") and not opened and depth <= 0 and bare.strip() and not bare.rstrip().endswith(("=", ",", "(", "|", "&", "+")):
                following = lines[n].strip() if n < len(lines) else ""
                ended = ended or not following.startswith(("{", "|", "&", ".", "=")) and item[0] not in ("func", "fun", "function", "class", "interface", "struct", "enum")
            if ended:
                close()
    if item is not None:
        close()
    elif held and any(x.strip() for x in held) and not seen:
        out.extend(_cut("\n".join(held).rstrip(), None, language, held_from, most))
    return out


def chunks_of(path: str, content: str, most: int = MAX_TOKENS) -> list[Piece]:
    """By lower-case extension; code without any item falls back to plain text."""
    ext = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if ext in ("md", "markdown"):
        return markdown(content, most)
    language = EXTENSIONS.get(ext)
    found = code(content, language, most) if language else []
    return found if any(p.symbol != "<prelude>" for p in found) else plain(content, most)


def chunk(files: DataFrame, path: str = "path", content: str = "content", most: int = MAX_TOKENS, chunker: Callable[[str, str, int], list[Piece]] = chunks_of) -> DataFrame:
    """Chunk rows of a table of files."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for file, text in zip(p[path], p[content], strict=True):
                for i, c in enumerate(chunker(file or "", text or "", most)):
                    rows.append((f"{file}:{i}", file, c.hierarchy, i, c.offset, len(c.content.encode()), hashlib.sha256(c.content.encode()).hexdigest(), c.content, c.language, c.symbol, c.signature, None if c.lines is None else {"start": c.lines[0], "end": c.lines[1]}))
            yield pd.DataFrame(rows, columns=[x.strip().split(" ")[0] for x in re.sub(r"<[^>]*>", "", SCHEMA).split(",")])

    return files.select(path, content).mapInPandas(run, SCHEMA)


def conversation(messages: DataFrame, source: str = "source_id", wing: str | None = None, hall: str | None = None, room: str | None = None) -> DataFrame:
    """One chunk per message: a header line and the text, with a running byte offset (one byte between messages)."""
    places = ["conversation", *[x for x in (wing, hall, room) if x]]
    text = F.concat(F.lit("[turn:"), F.col("turn_index"), F.lit("][role:"), F.col("role"), F.lit("]\n"), F.col("content"))
    w = Window.partitionBy(source).orderBy("turn_index")
    size = F.octet_length("text")
    lit = lambda x: F.lit(x).cast("string")
    return messages.withColumn("text", text).select(
        F.concat(F.col(source), F.lit(":"), F.row_number().over(w) - 1).alias("id"), F.col(source).alias("source_path"), F.array(*[F.lit(x) for x in places]).alias("heading_hierarchy"),
        (F.row_number().over(w) - 1).alias("chunk_index"), F.coalesce(F.sum(size + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long").alias("byte_offset"), size.cast("int").alias("byte_length"),
        F.sha2("text", 256).alias("content_hash"), F.col("text").alias("content"), F.lit("conversation").alias("language"), lit(room).alias("symbol"), lit(hall).alias("signature"),
    )


def reassemble(chunks: DataFrame, path: str = "source_path", sep: str = "\n") -> DataFrame:
    """The text of each path from its chunks in order."""
    return chunks.groupBy(path).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda x: x["content"]), sep).alias("content"))


def section(chunks: DataFrame, title: str) -> DataFrame:
    return reassemble(chunks.where(F.array_contains("heading_hierarchy", title)))


def doc_section(content: str, title: str) -> str:
    """From each exact heading to the next of the same or a higher level; repeated headings are appended."""
    out, level = [], None
    open_ = False
    for line in content.split("\n"):
        if fence(line):
            open_ = not open_
        h = None if open_ else heading(line)
        if h and level is not None and h[0] <= level:
            level = None
        if h and level is None and h[1] == title:
            level = h[0]
        if level is not None:
            out.append(line)
    return "\n".join(out)


def sections(docs: DataFrame, wanted: DataFrame, most: int | None = None, path: str = "path", content: str = "content") -> DataFrame:
    """(path, title, section) of the wanted (path, title): from the first exact heading to the next one of the same or a higher level, in at most
    ``most`` bytes; headings of the same title before that are part of it and set its level. Documents without the heading give no row.

    A heading is # signs, a space and a title, indented or not, in code fences as well. Lines carry their state in windows over (path, title) that run in
    line order and spill, and only lines that are returned meet in a row."""
    d, w = docs.alias("d"), wanted.select(path, "title").distinct().alias("w")
    asked = w.join(d, F.col(f"w.{path}") == F.col(f"d.{path}")).select(f"w.{path}", "w.title", F.posexplode(F.split(F.regexp_replace(F.col(f"d.{content}"), r"\r?\n\z", ""), "\\r?\\n")).alias("n", "line"))
    signs, name = F.regexp_extract("line", r"^\s*(#+)(?: |$)", 1), F.trim(F.regexp_extract("line", r"^\s*#+ (.*)$", 1))
    level = F.when((signs != "") & (name != ""), F.length(signs))
    run = Window.partitionBy(path, "title").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    now = asked.withColumn("level", level).withColumn("own", F.coalesce(F.col("level").isNotNull() & (name == F.col("title")), F.lit(False)))
    now = now.withColumn("at", F.last(F.when(F.col("own"), F.col("level")), ignorenulls=True).over(run))
    ends = F.coalesce(~F.col("own") & (F.col("level") <= F.col("at")), F.lit(False))
    now = now.withColumn("ended", F.max(ends).over(run)).where(F.col("at").isNotNull() & ~F.col("ended"))
    if most is not None:  # lines that begin, or whose line end before them lies, within the bytes
        now = now.withColumn("bytes", F.sum(F.octet_length("line") + 1).over(run)).where(F.col("bytes") - F.octet_length("line") - 1 <= most)
    out = now.groupBy(path, "title").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("section"))
    return out if most is None else out.withColumn("section", cut_bytes(F.col("section"), most))


def cut_bytes(c: Column, most: int) -> Column:
    """At most ``most`` bytes, cut at a character."""
    return F.when(F.octet_length(c) <= most, c).otherwise(_cut_udf(most)(c))


def _cut_udf(most: int) -> Callable[[Column], Column]:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else x.encode()[:most].decode(errors="ignore"))

    return run
