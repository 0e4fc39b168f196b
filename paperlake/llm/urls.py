"""URL filter: rules, and for the rest a tree of path templates.

The path segments of a host form a tree. A segment with many different values,
none of which dominates, is variable and becomes a wildcard; the others stay as
branches. A host with few addresses at a place is judged as all hosts are there. What rules decide is the labelled evidence: each template of a host
has counts of allowed and blocked addresses. Templates of one shape and similar
purity are merged over hosts, and a template is rejected if its own blocked
share, smoothed towards that of the merged branches and of the whole table,
reaches one half.

Cases: a null address, or one without ``://``, has empty host and path, fits no
rule, and is judged by the whole table's share; repeated rows count each; empty
segments are skipped; paths of any depth are judged to their last segment;
without labelled addresses everything is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlake.llm.common import stored
from paperlake.session import fresh_folder

#: Levels that are judged one by one in any case. From then on, where fewer than
#: ``VALUES`` paths are left no segment can be variable, and they end as they are.
DEPTH = 4
#: A segment is variable if it has so many values at least, none above this share.
VALUES, TOP_SHARE = 8, 0.5
#: Weight of the wider counts, in addresses, when a share is smoothed.
PRIOR = 4.0
BLOCKED_SHARE = 0.5

# The rules (host, path) and their verdicts.
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        domain, _, start = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + start)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _variable(values: Column, top: Column, total: Column) -> Column:
    return (values >= VALUES) & (top <= TOP_SHARE * total)


def templates(paths: DataFrame) -> DataFrame:
    """``paths`` (host, path, n, ...) with its template, level by level down the tree of each host.

    A level groups by host and the template so far, so a host with a third of
    all addresses is counted in every task before its counts meet. A level is
    written out, as the next one reads it more than once; it has only the paths
    that have a further segment. The others go to one folder.
    """
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    rows = paths.withColumn("template", F.substring("path", 1, 0)).withColumn("parts", parts)  # empty, yet no literal
    ended, names = fresh_folder(paths.sparkSession, "templates"), [*paths.columns, "template"]
    rows.where(F.size("parts") == 0).select(names).write.parquet(ended)
    rows, level = rows.where(F.size("parts") > 0), 0
    while not rows.isEmpty():
        rows = rows.withColumn("segment", F.get("parts", F.lit(level)))
        by_value = rows.groupBy("host", "template", "segment").agg(
            F.sum("n").alias("times"), F.count("*").alias("paths")
        )
        nodes = by_value.groupBy("host", "template").agg(
            F.count("*").alias("values"), F.max("times").alias("top"), F.sum("times").alias("all")
        )
        wide = by_value.groupBy("template", "segment").agg(
            F.sum("times").alias("times"), F.sum("paths").alias("paths")
        )
        wide = wide.groupBy(F.col("template").alias("wide_template")).agg(
            _variable(F.count("*"), F.max("times"), F.sum("times")).alias("wide_variable"),
            (F.sum("paths") < VALUES).alias("few"),
        )
        # A host with too few addresses at a node is judged as all hosts there.
        nodes = nodes.join(wide, F.col("template") == F.col("wide_template")).select(
            F.col("host").alias("node_host"), F.col("template").alias("node_template"),
            F.when(F.col("all") < VALUES, F.col("wide_variable"))
            .otherwise(_variable(F.col("values"), F.col("top"), F.col("all"))).alias("variable"),
            (F.col("few") if level >= DEPTH else F.lit(False)).alias("few"),
        )
        rows = rows.join(
            nodes, (F.col("host") == F.col("node_host")) & (F.col("template") == F.col("node_template"))
        ).drop("node_host", "node_template")
        rest = F.array_join(F.slice("parts", level + 1, F.size("parts")), "/")
        step = F.when(F.col("few"), rest).otherwise(F.when(F.col("variable"), F.lit("*")).otherwise(F.col("segment")))
        level += 1
        rows = stored(
            rows.select(
                *paths.columns, F.concat("template", F.lit("/"), step).alias("template"), "parts",
                (F.col("few") | (F.size("parts") == level)).alias("ends"),
            ),
            "tree",
        )
        rows.where("ends").select(names).write.mode("append").parquet(ended)
        rows = rows.where("NOT ends").drop("ends")
    return paths.sparkSession.read.schema(rows.select(names).schema).parquet(ended)


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    paths = stored(rows.groupBy("host", "path").agg(F.count("*").alias("n")).withColumn("says", says), "paths")
    shaped = templates(paths)
    known = F.when(F.col("says").isNotNull(), F.col("n")).otherwise(0)
    bad = F.when(F.col("says") == "block", F.col("n")).otherwise(0)
    branches = stored(
        shaped.groupBy("host", "template").agg(F.sum(known).alias("known"), F.sum(bad).alias("bad")), "branches"
    )
    total = branches.agg(F.sum("known").alias("known"), F.sum("bad").alias("bad")).first()
    share = (total["bad"] or 0) / total["known"] if total["known"] else 0.0
    # Branches of one shape merge where their purity falls in the same fifth;
    # branches without evidence take the largest of these, or all of the shape.
    own = (F.col("bad") + PRIOR * share) / (F.col("known") + PRIOR)
    alike = branches.withColumn(
        "fifth", F.when(F.col("known") > 0, F.least(F.floor(5 * own), F.lit(4))).otherwise(-1)
    )
    merged = alike.groupBy("template", "fifth").agg(F.sum("known").alias("like_known"), F.sum("bad").alias("like_bad"))
    shape = merged.groupBy("template").agg(F.sum("like_known").alias("all_known"), F.sum("like_bad").alias("all_bad"))
    wider = (
        merged.withColumnsRenamed({"template": "t", "fifth": "f"})
        .join(shape, F.col("t") == F.col("template"))
        .drop("template")
    )
    smoothed = lambda bad, known, toward: (bad + PRIOR * toward) / (known + PRIOR)
    of_shape = smoothed(F.col("all_bad"), F.col("all_known"), F.lit(share))
    of_alike = smoothed(F.col("like_bad"), F.col("like_known"), of_shape)
    judged = alike.join(wider, (F.col("template") == F.col("t")) & (F.col("fifth") == F.col("f"))).select(
        F.col("host").alias("h"),
        F.col("template").alias("t"),
        (smoothed(F.col("bad"), F.col("known"), of_alike) >= BLOCKED_SHARE).alias("rejected"),
    )
    verdicts = shaped.join(judged, (F.col("host") == F.col("h")) & (F.col("template") == F.col("t"))).select(
        F.col("host").alias("of_host"), F.col("path").alias("of_path"), "rejected"
    )
    return rows.join(
        verdicts, (F.col("host") == F.col("of_host")) & (F.col("path") == F.col("of_path")), "left"
    ).select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(says, F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
    )
