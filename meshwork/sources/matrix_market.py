"""Matrix Market files: a distributed reader and writer of coordinate files, headers of array files, and codes of types and errors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.operators.graph import Graph, added_up, lower_triangle, mirrored

FIELDS = ("real", "complex", "integer", "pattern")
SYMMETRIES = ("general", "symmetric", "hermitian", "skew-symmetric")
#: The format's error codes.
COULD_NOT_READ_FILE, PREMATURE_EOF, NOT_MTX, NO_HEADER, UNSUPPORTED_TYPE, LINE_TOO_LONG, COULD_NOT_WRITE_FILE = range(11, 18)
#: The letters of a typecode, by place.
LETTERS = [{"matrix": "M"}, {"coordinate": "C", "array": "A"}, {"real": "R", "complex": "C", "pattern": "P", "integer": "I"}, {"general": "G", "symmetric": "S", "hermitian": "H", "skew-symmetric": "K"}]
#: Characters of a line and of a word, at most.
MOST_LINE, MOST_WORD = 1025, 64
#: Lines of a file's first block read at once while the size line is looked for.
HEAD_LINES = 200
LOW_33_BITS = (1 << 33) - 1


class MatrixMarketError(ValueError):
    """A file that is no valid Matrix Market file, or of a kind that is not supported; code is the format's error code."""

    def __init__(self, text: str, code: int = UNSUPPORTED_TYPE):
        super().__init__(text)
        self.code = code


@dataclass
class Header:
    """A banner's words and the size line's numbers; entries is None for an array. The size line is line ``at`` of ``file``, from 0."""

    banner: str
    object: str
    format: str
    field: str
    symmetry: str
    rows: int
    columns: int
    entries: int | None
    file: str = ""
    at: int = 0
    files: tuple[str, ...] = ()


def typecode(object_: str, format_: str, field: str, symmetry: str) -> str:
    """Four letters for a banner's words."""
    try:
        return "".join(letters[word] for letters, word in zip(LETTERS, (object_, format_, field, symmetry), strict=True))
    except KeyError as e:
        raise MatrixMarketError(f"unsupported type: {e.args[0]}") from None


def typecode_words(code: str) -> str:
    """The banner's words for four letters."""
    words = [{v: k for k, v in letters.items()}.get(c) for letters, c in zip(LETTERS, code, strict=True)]
    if None in words:
        raise MatrixMarketError(f"unsupported typecode: {code}")
    return " ".join(words)


def is_valid(code: str) -> bool:
    """Whether the four letters go together."""
    try:
        _, format_, field, symmetry = typecode_words(code).split()
        check_type(format_, field, symmetry)
    except MatrixMarketError:
        return False
    return True


def parse_banner(line: str) -> tuple[str, str, str, str]:
    """(object, format, field, symmetry) of a banner, checked as the format's definition asks."""
    if len(line) > MOST_LINE:
        raise MatrixMarketError("the banner is too long", LINE_TOO_LONG)
    words = line.split()
    if len(words) != 5:
        raise MatrixMarketError("the banner has to have five words", PREMATURE_EOF)
    if words[0] != "%%MatrixMarket":
        raise MatrixMarketError("no Matrix Market banner", NO_HEADER)
    object_, format_, field, symmetry = (w.lower() for w in words[1:])
    typecode(object_, format_, field, symmetry)
    check_type(format_, field, symmetry)
    return object_, format_, field, symmetry


def check_type(format_: str, field: str, symmetry: str) -> None:
    """Reject dense patterns, real hermitian matrices, and patterns that are hermitian or skew."""
    if format_ == "array" and field == "pattern":
        raise MatrixMarketError("a dense matrix cannot be a pattern")
    if field == "real" and symmetry == "hermitian":
        raise MatrixMarketError("a real matrix cannot be hermitian")
    if field == "pattern" and symmetry in ("hermitian", "skew-symmetric"):
        raise MatrixMarketError("a pattern cannot be hermitian or skew-symmetric")


def banner_line(format_: str, field: str, symmetry: str) -> str:
    check_type(format_, field, symmetry)
    return f"%%MatrixMarket {typecode_words(typecode('matrix', format_, field, symmetry))}"


def size_line(rows: int, columns: int, entries: int | None = None) -> str:
    """The size line of a coordinate file, or of an array file, which has no number of entries."""
    return f"{rows} {columns}" if entries is None else f"{rows} {columns} {entries}"


def parse_size(line: str, format_: str) -> tuple[int, int, int | None]:
    """(rows, columns, entries) of a size line; entries is None for an array."""
    want = 2 if format_ == "array" else 3
    try:
        numbers = [int(w) for w in line.split()[:want]]
    except ValueError:
        raise MatrixMarketError(f"bad size line: {line}", PREMATURE_EOF) from None
    if len(numbers) < want:
        raise MatrixMarketError(f"bad size line: {line}", PREMATURE_EOF)
    return numbers[0], numbers[1], numbers[2] if want == 3 else None


def _is_body(line: str) -> bool:
    return not line.startswith("%") and line.strip() != ""


def _body() -> Column:
    return ~F.startswith("value", F.lit("%")) & (F.trim("value") != "")


def _numbered(spark: SparkSession, file: str) -> DataFrame:
    """(value, start, at): at is the line's place, from 0, within the block of the file that begins at byte start."""
    at = F.monotonically_increasing_id().bitwiseAND(F.lit(LOW_33_BITS))
    return spark.read.text(file).select("value", F.col("_metadata.file_block_start").alias("start"), at.alias("at"))


def _top(spark: SparkSession, files: list[str]) -> tuple[str, str, int, str]:
    """(banner, the file with the size line, its place there, the size line). Only the first lines of first blocks are read."""
    banner = None
    for file in files:
        lines, many = _numbered(spark, file).where("start = 0"), HEAD_LINES
        while True:
            head = [r.value for r in lines.where(F.col("at") < many).select("value", "at").limit(many).collect()]
            banner = head[0] if banner is None and head else banner
            for i, line in enumerate(head):
                if _is_body(line):
                    return banner, file, i, line
            if len(head) < many:
                break
            many *= 8
    if banner is None:
        raise MatrixMarketError("the file is empty", PREMATURE_EOF)
    raise MatrixMarketError("no size line", PREMATURE_EOF)


def read_header(spark: SparkSession, path: str, strict: bool = False) -> Header:
    """The header. Unless strict, the banner is only searched for its symmetry, as loaders commonly do.

    A folder's files count in the order of their names.
    """
    files = sorted(spark.read.text(path).inputFiles())
    banner, file, at, line = _top(spark, files)
    if strict:
        object_, format_, field, symmetry = parse_banner(banner)
    else:
        words = (banner.lower().split() + [""] * 5)[:5]
        object_, format_, field, symmetry = words[1:]
        symmetry = "general" if "general" in banner else "symmetric" if "symmetric" in banner else "general"
    return Header(banner, object_, format_, field, symmetry, *parse_size(line, format_), file, at, tuple(files))


def _words(spark: SparkSession, head: Header) -> DataFrame:
    """(x): the words of each entry's line. The size line goes by its place, since entries may repeat its text."""
    size_itself = (F.col("start") == 0) & (F.col("at") == head.at)
    lines = _numbered(spark, head.file).where(_body() & ~size_itself).select("value")
    others = [f for f in head.files if f != head.file]
    if others:
        lines = lines.union(spark.read.text(others).where(_body()))
    return lines.select(F.split(F.trim("value"), "[ \t]+").alias("x"))


def _number(i: int, kind: str = "double") -> Column:
    return F.try_element_at("x", F.lit(i)).cast(kind)


def _entries(spark: SparkSession, head: Header) -> DataFrame:
    """(a, b, w): 0-based, w null where an entry has no third word."""
    return _words(spark, head).select((_number(1, "long") - 1).alias("a"), (_number(2, "long") - 1).alias("b"), _number(3).alias("w"))


def read_mtx(spark: SparkSession, path: str, symmetric_weights: float | None = 1.0, lower_only: bool = True, aggregate: bool = True, check_count: bool = True) -> Graph:
    """An undirected graph from a coordinate file.

    A symmetric file (a skew-symmetric one too) gives its entries and their mirror images, the diagonal once, and every
    weight is symmetric_weights (None keeps those of the file). Of a general file only entries below the diagonal count, with their
    weights; lower_only=False keeps the others as well. An entry without a weight weighs 1. Parallel entries are added up; aggregate=False keeps
    them apart. The number of columns is the number of vertices.
    """
    head = read_header(spark, path)
    if head.entries is None:
        raise MatrixMarketError("a graph needs a coordinate file")
    found = _entries(spark, head).select("a", "b", F.coalesce("w", F.lit(1.0)).alias("w"))
    if head.symmetry == "symmetric":
        if check_count and (n := found.count()) != head.entries:
            raise MatrixMarketError(f"{head.entries} entries announced, {n} found", PREMATURE_EOF)
        if symmetric_weights is not None:
            found = found.withColumn("w", F.lit(symmetric_weights))
    edges = found.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w")
    if head.symmetry != "symmetric" and lower_only:
        edges = lower_triangle(edges)
    edges = mirrored(edges)
    return Graph(added_up(edges) if aggregate else edges, spark.range(head.columns).select(F.col("id").alias("v")))


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """(a, b, w): the entries of a valid coordinate file as they stand, 0-based; a pattern's weigh 1, complex ones have (a, b, w, im)."""
    head = read_header(spark, path, strict=True)
    if head.format != "coordinate":
        raise MatrixMarketError("entries need a coordinate file")
    if head.field == "complex":
        return _words(spark, head).select((_number(1, "long") - 1).alias("a"), (_number(2, "long") - 1).alias("b"), _number(3).alias("w"), _number(4).alias("im"))
    found = _entries(spark, head)
    return found.select("a", "b", F.lit(1.0).alias("w")) if head.field == "pattern" else found


def write_mtx(edges: DataFrame, path: str, n: int, field: str = "real", symmetry: str = "general") -> None:
    """Write (src, dst, w) as a coordinate file. A symmetric file gets the entries on and below the diagonal; see write_entries."""
    rows = edges.where("dst <= src") if symmetry != "general" else edges
    write_entries(rows.select(F.col("src").alias("a"), F.col("dst").alias("b"), "w"), path, n, n, field, symmetry)


def write_entries(entries: DataFrame, path: str, rows: int, columns: int, field: str = "real", symmetry: str = "general") -> None:
    """Write 0-based entries (a, b, w), complex ones (a, b, w, im), as a coordinate file.

    It is a folder of text parts, read back in the order of their names. Weights have 16 significant digits.
    """
    banner = banner_line("coordinate", field, symmetry)
    words = [(F.col("a") + 1).cast("string"), (F.col("b") + 1).cast("string")]
    if field in ("real", "complex"):
        words += [F.format_string("%.15e", F.col(c).cast("double")) for c in (("w",) if field == "real" else ("w", "im"))]
    elif field == "integer":
        words.append(F.col("w").cast("long").cast("string"))
    # the header is the first partition, so its part has the first name
    lines = entries.select(F.concat_ws(" ", *words).alias("value"))
    top = entries.sparkSession.createDataFrame([(banner,), (size_line(rows, columns, entries.count()),)], "value string").coalesce(1)
    top.union(lines).write.mode("overwrite").text(path)
