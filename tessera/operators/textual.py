"""Text operators over rows of lines: chunking, line search, doc comments, Markdown repairs, look-ups by name."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import highlight, lines
from tessera.session import materialize


def doc_comments(files: DataFrame) -> DataFrame:
    """(path, line, doc): runs of /// lines joined, with the number of the line below.

    Within a run a line's place less its rank among the marked lines is the same; both come from the array of lines.
    """
    pattern = r"^\s*///\s?(.*)$"
    marked = F.filter(F.transform(lines(F.col("body")), lambda x, i: F.struct(i.alias("i"), x.alias("text"))), lambda x: F.rlike(x["text"], F.lit(r"^\s*///")))
    runs = F.transform(marked, lambda x, k: F.struct((x["i"] - k).alias("run"), x["i"].alias("i"), F.regexp_extract(x["text"], pattern, 1).alias("t")))
    each = files.select("path", F.explode(runs).alias("x")).select("path", "x.run", "x.i", "x.t")
    grouped = each.groupBy("path", "run").agg(F.max("i").alias("last"), F.array_sort(F.collect_list(F.struct("i", "t"))).alias("all"))
    return grouped.select("path", (F.col("last") + 2).cast("long").alias("line"), F.array_join(F.transform("all", lambda x: x["t"]), " ").alias("doc"))


def dependency_files(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """(name, path): the first candidate path that exists, else the first file with that stem."""
    direct = candidates.join(files, F.col("candidate") == F.col("path")).select("name", "path", F.col("way").cast("long").alias("way"))
    stems = files.select("path", F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "").alias("name"))
    by_stem = candidates.select("name").distinct().join(stems, "name").groupBy("name").agg(F.min("path").alias("path")).select("name", "path", F.lit(99).cast("long").alias("way"))
    return direct.unionByName(by_stem).groupBy("name").agg(F.min_by("path", "way").alias("path"))


def _deletions(c: Column) -> Column:
    """A text and what is left of it without one or two of its characters."""
    def less(x):
        places = F.when(F.length(x) > 0, F.sequence(F.lit(1), F.length(x))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.lit(1 << 30))))

    one = F.array_distinct(less(c))
    return F.array_distinct(F.concat(F.array(c), one, F.flatten(F.transform(one, less))))


def suggestions(words: DataFrame, names: DataFrame) -> DataFrame:
    """(word, suggestion, distance): the nearest name within one edit for short words and two for others.

    Two texts within two edits share what is left after at most two characters go from each, so words meet names on those
    keys alone and the distance is tested only there.
    """
    keyed = words.select("word").distinct().select("word", F.explode(_deletions(F.col("word"))).alias("key"))
    known = names.select("tool").distinct().select("tool", F.explode(_deletions(F.col("tool"))).alias("key"))
    pairs = keyed.join(known, "key").select("word", "tool").distinct().withColumn("distance", F.levenshtein("word", "tool"))
    near = pairs.where(F.col("distance") <= F.when(F.length("word") <= 4, 1).otherwise(2))
    best = near.groupBy("word").agg(F.min(F.struct("distance", "tool")).alias("b"))
    return best.select("word", F.col("b.tool").alias("suggestion"), F.col("b.distance").cast("long").alias("distance"))


# ---- line search


def line_search(files: DataFrame, query: str) -> DataFrame:
    """(path, line_no, content, highlighted, before, after, line_score) of the lines that hold the query.

    A line scores 1, times 3 as a heading, times 2 if a word equals the query, times 1.5 if it begins with it. The lines
    around come from the array of a file's lines, so nothing is sorted.
    """
    low = query.lower()
    each = files.select("path", lines(F.col("body")).alias("all")).select("path", "all", F.posexplode("all").alias("i", "content"))
    hit = each.where(F.contains(F.lower("content"), F.lit(low)))
    lower = F.lower("content")
    score = F.when(F.startswith(F.trim("content"), F.lit("#")), 3.0).otherwise(1.0) * F.when(F.array_contains(F.split(lower, r"\s+"), low), 2.0).otherwise(1.0) * F.when(F.startswith(F.ltrim(lower), F.lit(low)), 1.5).otherwise(1.0)
    return hit.select("path", (F.col("i") + 1).cast("long").alias("line_no"), "content", highlight(F.col("content"), query).alias("highlighted"), F.when(F.col("i") > 0, F.get("all", F.col("i") - 1)).alias("before"), F.get("all", F.col("i") + 1).alias("after"), score.alias("line_score"))


def file_search(files: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """(path, matches, relevance): the sum of a file's lines, two more if its name holds the query."""
    by = line_search(files, query).groupBy("path").agg(F.count("*").alias("matches"), F.sum("line_score").alias("score"))
    bonus = F.when(F.contains(F.lower(F.substring_index("path", "/", -1)), F.lit(query.lower())), 2.0).otherwise(0.0)
    return by.select("path", "matches", (F.col("score") + bonus).alias("relevance")).orderBy(F.desc("relevance"), "path").limit(limit)


# ---- chunking


def chunk_fixed(docs: DataFrame, size: int, overlap: int, key: str = "id", body: str = "body") -> DataFrame:
    """(key, chunk_index, total_chunks, content): windows of ``size`` characters every size minus overlap, the last at the end."""
    step = size - overlap
    n = F.length(body)
    starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(F.lit(0), n - 1 - F.lit(overlap)), F.lit(step))).otherwise(F.array().cast("array<int>"))
    each = docs.select(key, body, F.size(starts).cast("long").alias("total_chunks"), F.posexplode(starts).alias("i", "start"))
    return each.select(key, F.col("i").cast("long").alias("chunk_index"), "total_chunks", F.substring(F.col(body), F.col("start") + 1, F.lit(size)).alias("content"))


def _tail(text: str, size: int) -> str:
    """The last bytes of a text, from a character's beginning on."""
    raw = text.encode()
    at = max(0, len(raw) - size)
    while at < len(raw) and raw[at] & 0xC0 == 0x80:
        at += 1
    return raw[at:].decode()


def markdown_chunks(body: str, size: int, overlap: int) -> Iterator[tuple[str, str]]:
    """(content, section): a first-level heading always begins a chunk, lower ones do when a chunk is full."""
    held, held_bytes, section = [], 0, ""
    stack: list[str] = []
    for line in body.splitlines():
        level = next((n for n in (1, 2, 3) if line.startswith("#" * n + " ")), 0)
        if level and held and (level == 1 or held_bytes >= size):
            yield "".join(held), section
            held, held_bytes = [], 0
        if level:
            stack = [*stack[: level - 1], line[level + 1 :].strip()]
            section = " > ".join(stack)
        held.append(line + "\n")
        held_bytes += len(line.encode()) + 1
        if held_bytes >= size + overlap:
            whole = "".join(held)
            yield whole, section
            rest = _tail(whole, overlap)
            held, held_bytes = [rest], len(rest.encode())
    if "".join(held).strip():
        yield "".join(held), section


#: What begins a statement.
STATEMENTS = ("CREATE", "ALTER", "DROP", "INSERT", "UPDATE", "DELETE", "GRANT", "REVOKE", "-- ==", "-- --")


def sql_chunks(body: str, size: int, overlap: int) -> Iterator[tuple[str, str]]:
    """(content, object): full chunks end where a statement begins; the object is the last table or view created."""
    import re

    held, held_bytes, context = [], 0, ""
    for line in body.splitlines():
        if held_bytes >= size and line.lstrip().upper().startswith(STATEMENTS):
            yield "".join(held), context
            held, held_bytes = [], 0
        if m := re.search(r"create (?:table|view)\s+[\"'`\[]*([^\s(\[\"'`\]]+)", line, re.I):
            context = m[1]
        held.append(line + "\n")
        held_bytes += len(line.encode()) + 1
    if "".join(held).strip():
        yield "".join(held), context


def paragraph_chunks(body: str, size: int, overlap: int) -> Iterator[tuple[str, str]]:
    """(content, nothing): paragraphs fill a chunk until the next would exceed the size; its tail leads the next chunk."""
    held = ""
    for paragraph in body.split("\n\n"):
        if held and len(held.encode()) + len(paragraph.encode()) > size:
            yield held, ""
            held = _tail(held, overlap)
        held = f"{held}\n\n{paragraph}" if held else paragraph
    if held.strip():
        yield held, ""


CHUNKERS = {"markdown": markdown_chunks, "sql": sql_chunks, "paragraph": paragraph_chunks}


def chunked(docs: DataFrame, kind: str, size: int, overlap: int, key: str = "id", body: str = "body") -> DataFrame:
    """(key, chunk_index, total_chunks, section, content) by one of CHUNKERS; a task holds one text at a time."""
    own = CHUNKERS[kind]

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = []
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = list(own(text or "", size, overlap))
                rows += [(k, i, len(found), section, content) for i, (content, section) in enumerate(found)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = [b.column(0).type, pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[key, "chunk_index", "total_chunks", "section", "content"])

    from tessera.session import workers_import

    workers_import(docs.sparkSession)
    return docs.select(key, body).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, chunk_index bigint, total_chunks bigint, section string, content string")


def prompt_parts(files: DataFrame, least: int = 10_000, size: int = 8000, overlap: int = 200) -> DataFrame:
    """(collection, id, part_no, part) of files (id, collection, path, body): what a prompt holds, whole, a row for a part.

    In order of id (null first, the header) and part_no the parts of a collection make its prompt. Texts of ``least`` bytes
    or more come as chunks with part numbers. Nothing is gathered, so a collection may have any size.
    """
    key = files.select(F.struct("id", "collection", "path").alias("key"), "body")
    long = F.octet_length("body") >= least
    whole = key.where(~F.coalesce(long, F.lit(False))).select("key", F.lit(0).cast("long").alias("chunk_index"), F.lit(1).cast("long").alias("total_chunks"), F.lit("").alias("section"), F.coalesce("body", F.lit("")).alias("content"))
    each = whole.unionByName(chunked(key.where(long), "markdown", size, overlap, "key")).select("key.*", "*").drop("key")
    number = F.concat((F.col("chunk_index") + 1).cast("string"), F.lit("/"), F.col("total_chunks").cast("string"))
    many, section = F.col("total_chunks") > 1, F.coalesce("section", F.lit(""))
    title = F.concat(F.substring_index("path", "/", -1), F.when(many, F.concat(F.when(section != "", F.concat(F.lit(" - "), section)).otherwise(""), F.lit(" (Part "), number, F.lit(")"))).otherwise(""))
    chunk = F.when(many, F.concat(F.lit("**Chunk:** "), number, F.lit("\n"), F.when(section != "", F.concat(F.lit("**Section:** "), section, F.lit("\n"))).otherwise(""))).otherwise("")
    part = F.concat(F.lit("\n---\n\n## "), title, F.lit("\n\n**Source:** "), "path", F.lit("\n"), chunk, F.lit("**Type:** Markdown\n\n"), "content", F.lit("\n\n"))
    head = files.select("collection").distinct().select("collection", F.lit(None).cast(files.schema["id"].dataType).alias("id"), F.lit(0).cast("long").alias("part_no"), F.lit("# Local Technical Documentation\n\n").alias("part"))
    return head.unionByName(each.select("collection", "id", (F.col("chunk_index") + 1).alias("part_no"), part.alias("part")))


def placed(parts: DataFrame) -> DataFrame:
    """(collection, id, place, start, part): the place of each part (collection, id, part) in its collection's text, from 1, and its first character.

    A collection's text is its parts by id, then part, nulls last, with a line end between. Rows are sorted in ranges and a range's
    parts are counted there, so no task holds a collection; what ranges hold before is a row for each of them and collection.
    """
    order = [F.asc_nulls_last("id"), F.asc_nulls_last("part")]
    ranged = parts.repartitionByRange("collection", order[0]).select("collection", "id", "part", F.coalesce(F.length("part") + 1, F.lit(0)).cast("long").alias("chars"), F.spark_partition_id().alias("range"))
    ranged = materialize(ranged, "parts")
    sums = ranged.groupBy("collection", "range").agg(F.count("*").alias("n"), F.sum("chars").alias("sum"))
    before = Window.partitionBy("collection").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("collection").alias("c"), F.col("range").alias("r"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("places"), F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("from"))
    own = Window.partitionBy("collection", "range").orderBy(*order)
    within = F.coalesce(F.sum("chars").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = ranged.select("*", F.row_number().over(own).alias("k"), within.alias("within"))
    met = each.join(F.broadcast(sums), F.col("collection").eqNullSafe(F.col("c")) & (F.col("range") == F.col("r")))
    return met.select("collection", "id", (F.col("places") + F.col("k")).alias("place"), (F.col("from") + F.col("within")).alias("start"), "part")


# ---- Markdown


def fixed_markdown(files: DataFrame) -> DataFrame:
    """(path, line, text): first-level headings after the first drop a level, empty links point to #, empty headings go."""
    own = lines(F.col("body"))
    first = F.array_position(F.transform(own, lambda x: F.startswith(x, F.lit("# "))), True)
    each = files.select("path", first.alias("first"), F.posexplode(own).alias("i", "text"))
    text = F.when(F.startswith("text", F.lit("# ")) & (F.col("i") + 1 > F.col("first")), F.concat(F.lit("#"), F.col("text"))).otherwise(F.col("text"))
    out = each.select("path", (F.col("i") + 1).cast("long").alias("line"), F.regexp_replace(text, r"\]\(\s*\)", "](#)").alias("text"))
    return out.where(~F.rlike("text", F.lit(r"^#{1,6}\s*$")))


def trimmed_markdown(files: DataFrame, limit: int = 500) -> DataFrame:
    """(path, line, text) without fenced blocks and empty lines among the first lines."""
    start = F.struct(F.lit(False).alias("open"), F.array().cast("array<struct<i:int,text:string>>").alias("out"))

    def step(acc, x):
        fence = F.startswith(F.trim(x["text"]), F.lit("```"))
        kept = ~fence & ~acc["open"] & (F.trim(x["text"]) != "")
        return F.struct((acc["open"] != fence).alias("open"), F.when(kept, F.concat(acc["out"], F.array(x))).otherwise(acc["out"]).alias("out"))

    head = F.transform(F.slice(lines(F.col("body")), 1, limit), lambda x, i: F.struct(i.cast("int").alias("i"), x.alias("text")))  # no more than limit lines
    each = files.select("path", F.explode(F.aggregate(head, start, step, lambda acc: acc["out"])).alias("x"))
    return each.select("path", (F.col("x.i") + 1).cast("long").alias("line"), "x.text")


SUPPLEMENTARY = ("CLAUDE.md", "CONTRIBUTING.md", "docs/README.md")


def supplementary(files: DataFrame, candidates: tuple[str, ...] = SUPPLEMENTARY, limit: int = 4000) -> DataFrame:
    """(project, context) of files (project, path, body): the candidates that exist, trimmed and joined in their order.

    Of the first 500 lines, fenced blocks and empty lines go; of each file ``limit`` bytes stay, whole characters, with a mark.
    A project without any such text has no row; null texts count as empty.
    """
    rank = F.array_position(F.array(*map(F.lit, candidates)), F.col("path"))
    first = F.struct(F.lit(False).alias("open"), F.lit("").alias("kept"))

    def line(acc, x):
        kept = F.when(~acc["open"] & F.rlike(x, F.lit(r"(?U)\S")), F.concat(acc["kept"], x, F.lit("\n"))).otherwise(acc["kept"])
        fence = F.startswith(x, F.lit("```"))
        return F.struct((acc["open"] != fence).alias("open"), F.when(fence, acc["kept"]).otherwise(kept).alias("kept"))

    trimmed = F.aggregate(F.slice(lines(F.coalesce("body", F.lit(""))), 1, 500), first, line, lambda acc: acc["kept"])
    each = files.where(F.col("path").isin(*candidates)).select("project", "path", rank.alias("rank"), trimmed.alias("text")).where("text <> ''")
    raw = F.encode("text", "UTF-8")
    cut = F.coalesce(*[F.when(~F.hex(F.substring(raw, k + 1, 1)).between("80", "BF"), F.decode(F.substring(raw, 1, k), "UTF-8")) for k in range(limit, limit - 4, -1)])
    text = F.when(F.octet_length("text") > limit, F.concat(cut, F.lit("...(truncated)"))).otherwise(F.col("text"))
    part = F.concat(F.lit("#### From "), "path", F.lit("\n"), text, F.lit("\n\n"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", part.alias("part")))), lambda x: x["part"]), "")
    return each.groupBy("project").agg(joined.alias("context"))


def truncated(files: DataFrame, budget: int, important) -> DataFrame:
    """(path, line, text): important lines first, then the others, each kind up to the first that exceeds the budget.

    The second kind goes on from the length the first one reached. What is kept is bounded by the budget.
    """
    numbered = F.transform(lines(F.col("body")), lambda x, i: F.struct(i.cast("int").alias("i"), x.alias("text")))
    none = F.array().cast("array<struct<i:int,text:string>>")

    def kept(begin, wanted):
        def step(acc, x):
            sum_ = acc["sum"] + F.when(wanted(x["text"]), F.length(x["text"]) + 1).otherwise(0)
            fits = wanted(x["text"]) & (sum_ <= budget)
            return F.struct(sum_.cast("long").alias("sum"), F.when(fits, sum_).otherwise(acc["used"]).cast("long").alias("used"), F.when(fits, F.concat(acc["out"], F.array(x))).otherwise(acc["out"]).alias("out"))

        return F.aggregate(numbered, F.struct(begin.cast("long").alias("sum"), begin.cast("long").alias("used"), none.alias("out")), step)

    first = files.select("path", "body", kept(F.lit(0), important).alias("a"))
    both = first.select("path", "a", kept(F.col("a.used"), lambda x: ~important(x)).alias("b"))
    return both.select("path", F.explode(F.concat("a.out", "b.out")).alias("x")).select("path", (F.col("x.i") + 1).cast("long").alias("line"), "x.text")
