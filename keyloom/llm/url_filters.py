"""URL rules by a sort-merge range join.

A host's canonical key is its labels in reverse, each ended by a dot: ``m.example.net`` is ``net.example.m.``. A rule's
host is then a prefix of the keys it fits, that is, an interval of them; intervals of two rules are nested or apart.
Hosts and rules are sorted together and swept: the rule last begun, with the rules around it, is the stack of what may
still be open, and a host keeps of it the rules whose interval it lies in. The same is done once more with paths: a key
is a rule's host and a page's path, and rules are intervals of those. So neither the rules of one host nor its pages are
ever gathered.

Pages are reduced to distinct hosts, then to distinct hosts and paths, before they are sorted, so what a third of all
pages have is one row. Sorts are cut into ranges; each begins with the stack that the range before it left. Only
DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyloom.llm.common import BROADCAST_BYTES, discard, written

#: (action, host, path): the default rules, of which the longest that fits wins.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

#: Between host and path in a key: less than any sign of either.
BETWEEN = "\0"

#: Distinct keys and rules that one task sweeps.
SWEPT_ROWS = 1_000_000


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or end, A-Z lower-cased; path: then up to ``?``, ``#`` or end. Both empty without ``://``."""
    start = F.locate("://", url)
    rest = F.substring(url, start + 3, F.length(url))
    rest = F.when(start > 0, rest).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return lower_ascii(host), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def canonical(host: Column) -> Column:
    return F.concat(F.concat_ws(".", F.reverse(F.split(host, r"\."))), F.lit("."))


def both(host_key: Column, path: Column) -> Column:
    """Key of a rule's host and a path."""
    return F.concat(host_key, F.lit(BETWEEN), path)


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    entries = [F.struct(F.lit(action).alias("action"), F.lit(host).alias("host"), F.lit(path).alias("path")) for action, host, path in rules]
    return spark.range(1).select(F.inline(F.array(*entries)))


def nested(prefixes: DataFrame, forms: Column) -> DataFrame:
    """key and stack of each distinct ``key``: of its shorter ``forms``, those that are keys as well, and itself, by length."""
    keys = prefixes.select("key").distinct()
    around = keys.select(F.col("key").alias("inner"), F.explode(forms).alias("key")).join(keys, "key")
    return around.groupBy("inner").agg(F.array_sort(F.collect_set("key")).alias("stack")).select(F.col("inner").alias("key"), "stack")


def sweep(keys: DataFrame, begun: DataFrame, swept_rows: int = SWEPT_ROWS) -> DataFrame:
    """key, stack of each distinct ``key`` that lies in the interval of one of ``begun``: those around it, by length.

    ``begun``: what ``nested`` gives. The stack has as many entries as intervals are nested: a host's labels, a path's length.
    """
    none = F.lit(None).cast(begun.schema["stack"].dataType)
    events = written(keys.select("key").distinct().select("key", none.alias("stack")).unionByName(begun), "events")
    ranges = max(1, -(-events.count() // swept_rows))
    events = events.withColumn("begins", F.col("stack").isNotNull())
    placed = written(events.repartitionByRange(ranges, "key").withColumn("range", F.spark_partition_id()), "swept")
    # what a range leaves open is at most the rule it began last; the next ranges carry it on
    left = placed.where("begins").groupBy("range").agg(F.max_by("stack", "key").alias("stack"))
    carried = spark_range(placed.sparkSession, ranges).join(left, "range", "left").select(
        "range", F.last("stack", ignorenulls=True).over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)).alias("carried")
    )  # one row a range
    order = Window.partitionBy("range").orderBy("key", F.desc("begins")).rowsBetween(Window.unboundedPreceding, 0)
    open_ = F.coalesce(F.last("stack", ignorenulls=True).over(order), F.col("carried"))
    found = placed.join(carried, "range").withColumn("stack", open_).where("not begins")
    inside = F.filter("stack", lambda r: F.startswith(F.col("key"), r))
    found = written(found.select("key", inside.alias("stack")).where(F.size("stack") > 0), "found")
    discard(events, placed)
    return found


def spark_range(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias("range"))


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", swept_rows: int = SWEPT_ROWS) -> DataFrame:
    """``pages``, all columns and rows, with host, path, rule (``host`` and path of the rule that wins; else null) and verdict.

    A rule fits its host and all subdomains if the page's path starts with the rule's. The longest wins, by host and then
    path; of rules alike in both, the first action in alphabetical order. Null urls and those without ``://`` have
    empty host and path and get ``default``, as all do that no rule fits. Columns named as the four are replaced, others
    may have any name; repeated rows and null ids are judged one by one; an empty table stays empty.
    """
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    host, path = host_and_path(F.coalesce(pages[url_col].cast("string"), F.lit("")))
    page = F.struct(*[pages[c] for c in keep], host.alias("host"), path.alias("path"))  # so that no name clashes with ours
    judged = pages.select(page.alias("page"), canonical(host).alias("key"), path.alias("at"))
    rules = rules.select("action", lower_ascii(F.col("host")).alias("host"), "path")
    rules = rules.select(canonical(F.col("host")).alias("key"), "path", "action", F.concat("host", "path").alias("rule")).groupBy("key", "path").agg(F.min(F.struct("action", "rule")).alias("r"))
    rules = rules.select("key", both(F.col("key"), F.col("path")).alias("whole"), "r.action", "r.rule")
    labels = F.split(F.expr("substring(key, 1, length(key) - 1)"), r"\.")
    shorter = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.concat_ws(".", F.slice(labels, 1, n)), F.lit(".")))
    hosts = sweep(judged.select("key"), nested(rules, shorter), swept_rows)
    asked = judged.select("key", "at").distinct().join(hosts, "key").select("key", "at", F.explode("stack").alias("of"))
    asked = written(asked.withColumn("whole", both(F.col("of"), F.col("at"))), "asked")
    start = F.locate(BETWEEN, F.col("key"))
    prefixes = F.transform(F.sequence(start, F.length("key")), lambda n: F.substring(F.col("key"), F.lit(1), n))
    paths = sweep(asked.select(F.col("whole").alias("key")), nested(rules.select(F.col("whole").alias("key")), prefixes), swept_rows)
    hits = asked.join(paths.select(F.col("key").alias("whole"), F.element_at("stack", -1).alias("rule_key")), "whole")
    best = hits.groupBy("key", "at").agg(F.max_by("rule_key", F.length("of")).alias("whole"))
    best = written(best.join(rules.select("whole", "action", "rule"), "whole").select("key", "at", "action", "rule"), "verdicts")
    size = best.agg(F.sum(F.octet_length("key") + F.octet_length("at") + F.octet_length("rule") + 96)).first()[0] or 0
    judged = judged.join(F.broadcast(best) if size <= BROADCAST_BYTES else best, ["key", "at"], "left")
    own = [F.col("page").getField(c).alias(c) for c in (*keep, "host", "path")]
    return judged.select(*own, "rule", F.coalesce("action", F.lit(default)).alias("verdict"))
