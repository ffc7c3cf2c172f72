"""Secrets by corpus-wide ownership.

Candidates are found by regular expressions in whole texts. Their values' hashes are counted over the corpus: in how
many repositories and by how many owners a value occurs. A value that looks random and belongs to few is live; one
that is widely copied is an example. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm.common import BROADCAST_BYTES, unused, written

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""

#: (kind, pattern, group of the value, least length of the value). The first three are the base; longer runs of the last are candidates of the method alone.
KINDS = (
    ("assign", ASSIGN, 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
    ("long", r"[A-Za-z0-9+/_-]{32,}", 0, 32),
)
BASE = ("assign", "access", "hex")

#: A value is live if no more owners than these have it, and if two have it, in no more repositories than these.
MOST_OWNERS, MOST_REPOSITORIES = 2, 10

LIVE = "live"

#: Signs that values are of, whatever their kind, and the least length of one.
SIGNS, LEAST = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-", min(least for *_, least in KINDS)

#: Live values of a row up to which they are replaced one after another in its whole text.
FEW_VALUES = 64


def matches(text: Column, pattern: str, group: int) -> Column:
    """Array of (gap: code points since the match before, length, value) of the leftmost matches, without overlaps."""
    whole = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.transform(F.split(text, pattern, -1), lambda piece: F.length(piece))
    zipped = F.arrays_zip(F.slice(gaps, 1, F.size(whole)).alias("gap"), whole.alias("whole"), value.alias("value"))
    found = F.transform(zipped, lambda m: F.struct(m["gap"].alias("gap"), F.length(m["whole"]).alias("length"), m["value"].alias("value")))
    return F.when(text.rlike(pattern), found)


def looks_random(value: Column) -> Column:
    """Letters and digits, at least eight different signs, and no word that placeholders have. Values are of ``SIGNS``, and may be long."""
    different = F.size(F.filter(F.array(*map(F.lit, SIGNS)), lambda sign: F.contains(value, sign)))
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (different >= 8) & ~value.rlike("(?i)example|sample|changeme|placeholder|x{6}|0{8}|12345678")


def candidates(docs: DataFrame, keep: list[str], owner_col: str | None, repository_col: str | None, text_col: str) -> DataFrame:
    """_row, row (struct of the ``keep`` columns), owner, repository and the matches of each kind, written: one row per document."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    owner = F.coalesce(docs[owner_col].cast("string"), F.lit("")) if owner_col else F.lit("")
    repository = F.coalesce(docs[repository_col].cast("string"), F.lit("")) if repository_col else F.xxhash64(text).cast("string")
    row = F.struct(*[docs[c] for c in keep], F.lit(True).alias(unused(docs, "there")))
    found = docs.select(F.monotonically_increasing_id().alias("_row"), row.alias("row"), owner.alias("owner"), repository.alias("repository"), text.alias("text"))
    kinds = [matches(F.col("text"), pattern, group).alias(kind) for kind, pattern, group, _ in KINDS]
    return written(found.select("_row", "row", "owner", "repository", *kinds), "candidates")


def spans_of(found: DataFrame) -> DataFrame:
    """_row, owner, repository, kind, start, end, value, hash, random of all candidates that are long enough, written."""
    every = None
    for kind, _, _, least in KINDS:
        part = found.where(F.col(kind).isNotNull()).select("_row", "owner", "repository", F.posexplode(kind).alias("k", "m"))
        before = Window.partitionBy("_row").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
        end = F.sum(F.col("m.gap") + F.col("m.length")).over(before)
        part = part.select("_row", "owner", "repository", F.lit(kind).alias("kind"), (end - F.col("m.length")).alias("start"), end.alias("end"), F.col("m.value").alias("value"))
        part = part.where(F.length("value") >= least)
        every = part if every is None else every.unionByName(part)
    return written(every.withColumn("hash", F.sha2("value", 256)).withColumn("random", looks_random(F.col("value"))), "spans")


def live_hashes(spans: DataFrame) -> DataFrame:
    """hash of the values that are live: by owners and repositories over the corpus that ``spans`` are of.

    Copies of a text are one repository, so that copying it doesn't make its secrets examples; whoever has a copy is an
    owner. Rows are made distinct before they are counted, so a value in a third of all rows is few.
    """
    pairs = spans.where("random").select("hash", "owner", "repository").distinct()
    counts = pairs.groupBy("hash").agg(F.count_distinct("owner").alias("owners"), F.count_distinct("repository").alias("repositories"))
    return counts.where((F.col("owners") <= MOST_OWNERS) & ((F.col("owners") == 1) | (F.col("repositories") <= MOST_REPOSITORIES))).select("hash", F.lit(True).alias("known"))


def scan(docs: DataFrame, owner_col: str | None = "source", repository_col: str | None = None, keep: list[str] | None = None, text_col: str = "text", corpus: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows (_row and row, a struct of the ``keep`` columns, one per document) and spans (_row, kind, start, end, value, live).

    start, end: code points, end exclusive, of the whole match; the value is its last part. A null owner is an owner of
    its own; without ``repository_col`` each distinct text is a repository. Null texts count as empty. ``corpus``: where
    owners are counted, with the same columns; the documents themselves if it isn't given.
    """
    found = candidates(docs, keep or [], owner_col, repository_col, text_col)
    spans = spans_of(found)
    counted = spans if corpus is None else spans_of(candidates(corpus, [], owner_col, repository_col, text_col))
    judged = spans.join(live_hashes(counted), "hash", "left").withColumn("live", F.col("random") & F.coalesce("known", F.lit(False)))
    return found.select("_row", "row"), judged.select("_row", "kind", "start", "end", "value", "live")


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, then end, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_spans(docs: DataFrame, owner_col: str | None = "source", repository_col: str | None = None, id_col: str = "doc_id", text_col: str = "text", corpus: DataFrame | None = None) -> DataFrame:
    """One row per document: its id, n_assign, n_access, n_hex, n_live, base, spans.

    base: kind:start:end of the base spans. spans: these, and of each live value ``live:start:end`` of the value alone.
    Documents without spans have zeros and empty strings; repeated rows and null ids have a row each; columns of any names
    may be there; an empty table stays empty.
    """
    rows, spans = scan(docs, owner_col, repository_col, [id_col], text_col, corpus)
    order = F.element_at(F.create_map(*[x for k, kind in enumerate((*BASE, LIVE)) for x in (F.lit(kind), F.lit(k))]), F.col("kind"))
    entry = F.struct("start", order.alias("order"), "end", "kind")
    base = spans.where(F.col("kind").isin(*BASE)).select("_row", "kind", "start", "end")
    live = spans.where("live").select("_row", F.lit(LIVE).alias("kind"), (F.col("end") - F.length("value")).alias("start"), "end").distinct()
    per = base.unionByName(live).withColumn("e", entry).groupBy("_row").agg(
        *[F.count(F.when(F.col("kind") == kind, 1)).alias(f"n_{kind}") for kind in (*BASE, LIVE)],
        joined(F.collect_list(F.when(F.col("kind") != LIVE, F.col("e")))).alias("base"), joined(F.collect_list("e")).alias("spans"),
    )
    none = {f"n_{kind}": 0 for kind in (*BASE, LIVE)} | {"base": "", "spans": ""}
    return rows.join(per, "_row", "left").na.fill(none).select(F.col("row").getField(id_col).alias(id_col), *none)


def replaced(text: Column, live: Column, mark: str) -> Column:
    """``text`` with ``mark`` in place of each value of ``live`` (an array of ``longest_first``), one after another."""
    return F.aggregate(live, text, lambda t, v: F.replace(t, v["value"], F.lit(mark)))


def longest_first() -> Column:
    return F.sort_array(F.collect_list(F.struct((-F.length("value")).alias("n"), "value"))).alias("live")


def redacted_by_piece(texts: DataFrame, live: DataFrame, mark: str) -> DataFrame:
    """_row and text of ``texts`` (the same columns), with ``mark`` for the values that ``live`` (_row, value) has of the row.

    For rows of many values: the text is cut into pieces that end with a run of signs that the row's values have, so no
    value crosses a cut, and in a piece only the values whose first signs it holds are replaced. As if all were, one after another.
    """
    signs = F.concat(F.lit("[A-Za-z0-9"), *[F.when(F.max(F.contains("value", F.lit(c))), c).otherwise("") for c in "+/_.=-"], F.lit("]"))
    cut = texts.join(live.groupBy("_row").agg(signs.alias("signs")), "_row")
    piece = F.posexplode(F.regexp_extract_all("text", F.concat(F.lit("(?s).*?"), "signs", F.lit(f"{{{LEAST},}}|.+")), F.lit(0)))
    pieces = written(cut.select("_row", "signs", piece.alias("at", "piece")), "pieces")
    first = F.regexp_extract_all("piece", F.concat(F.lit("(?=("), "signs", F.lit(f"{{{LEAST}}}))")), F.lit(1))
    begins = pieces.select("_row", "at", F.explode(F.array_distinct(first)).alias("first"))
    there = begins.join(live.withColumn("first", F.left("value", F.lit(LEAST))), ["_row", "first"])
    out = pieces.join(there.groupBy("_row", "at").agg(longest_first()), ["_row", "at"], "left")
    clean = F.when(F.col("live").isNull(), F.col("piece")).otherwise(replaced(F.col("piece"), F.col("live"), mark))
    whole = F.sort_array(F.collect_list(F.struct("at", clean.alias("piece"))))
    return out.groupBy("_row").agg(F.array_join(whole["piece"], "").alias("text"))


def redact_live(docs: DataFrame, owner_col: str = "source", repository_col: str | None = None, text_col: str = "text", mark: str = "[SECRET]", corpus: DataFrame | None = None) -> DataFrame:
    """``docs``, all rows and columns, with ``mark`` in place of each live value, wherever in the rows that have it. Examples stay.

    ``corpus``: where owners are counted, such as the documents before they were deduplicated. The values of a row go to it by
    its place; they are broadcast if their bytes are few, else the rows are shuffled once. Nulls, repeated rows and columns
    of any names stay as they are; an empty table stays empty. Longer values go first, wherever they overlap. Rows of more
    than ``FEW_VALUES`` values are cut into pieces, else each value would be sought in the whole text.
    """
    rows, spans = scan(docs, owner_col, repository_col, docs.columns, text_col, corpus)
    live = written(spans.where("live").select("_row", "value").distinct(), "live-values")
    many = written(live.groupBy("_row").count().where(F.col("count") > FEW_VALUES).select("_row"), "many-values")
    few = live.join(many, "_row", "left_anti")
    size = few.agg(F.sum(F.octet_length("value") + 64)).first()[0] or 0
    per = few.groupBy("_row").agg(longest_first())
    out = rows.join(F.broadcast(per) if size <= BROADCAST_BYTES else per, "_row", "left")
    text = F.col("row").getField(text_col)
    clean = F.when(F.col("live").isNull(), text).otherwise(replaced(text, F.col("live"), mark))
    if not many.isEmpty():
        texts = rows.join(many, "_row", "left_semi").select("_row", text.alias("text"))
        pieced = written(redacted_by_piece(texts, live.join(many, "_row", "left_semi"), mark), "redacted")
        out = out.join(pieced, "_row", "left")
        clean = F.coalesce("text", clean)
    return out.select(*[clean.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
