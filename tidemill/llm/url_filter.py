"""URL verdicts by rules, and by a tree of path templates with labelled purity.

Each host has a tree of the segments of its paths. A segment that varies from page to
page is a wildcard: digits within a segment become ``#`` at once, and below a node
what has only one or two pages there becomes ``*``. A branch, however small its share, whose share of good labels does
not differ from that of all its siblings by more than chance is merged into ``*`` as
well. What remains are templates; one is rejected if the share of good labels among
its pages, smoothed towards that of all pages, is too low.

The tree is built from one row per host and masked path, so its size follows the
variety of paths, and pages of one host meet in partial sums only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import small_side, store
from tidemill.shared import new_folder

#: (verdict, rule): a rule is a host, and all its subdomains, and the beginning of a path.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: Levels that the SQL beside the query spells out; the tree itself goes down to the longest path.
DEPTH = 4
#: A segment stays as it is if it has this share (in hundredths) of its node's pages (none is
#: asked for: its labels decide), and so many pages.
COMMON_SHARE, COMMON_PAGES = 0, 3
#: Branches merge unless their squared z-score is above this (about 1 in 100 by chance).
APART = 6.635
#: Weight of the share of good labels of all pages, in labels, and the share below which a template goes.
PRIOR, LEAST_GOOD = 8.0, 0.5


def _after_scheme(url: str) -> Column:
    """What follows the first ``://``; empty if there is none."""
    text = F.coalesce(F.col(url), F.lit(""))
    spot = F.instr(text, "://")
    return F.when(spot > 0, F.substring(text, spot + 3, F.length(text))).otherwise("")


def host_of(url: str = "url") -> Column:
    """The host, A-Z in lower case: after the first ``://``; empty if there is none."""
    host = F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str = "url") -> Column:
    """The path, from the host's end up to ``?`` or ``#``."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def rule_of(rules=RULES) -> Column:
    """The longest rule that fits ``host`` and ``path``; null if none does."""
    by_length = sorted((rule for _, rule in rules), key=lambda r: (-len(r), r))

    def fits(rule: str) -> Column:
        host, _, path = rule.partition("/")
        named = (F.col("host") == host) | F.col("host").endswith(f".{host}")
        return named & F.col("path").startswith(f"/{path}")

    first, *others = by_length
    chosen = reduce(lambda c, r: c.when(fits(r), r), others, F.when(fits(first), first))
    return chosen.otherwise(F.lit(None).cast("string"))


def masked_segments() -> Column:
    """Segments of ``path`` with digits masked."""
    parts = F.filter(F.split("path", "/"), lambda s: s != "")
    return F.transform(parts, lambda s: F.regexp_replace(s, "[0-9]+", "#"))


def _level(paths: DataFrame, depth: int) -> DataFrame:
    """Extends ``template`` of every path, all deeper than ``depth``, by its segment there or a wildcard."""
    node = ["host", "template"]
    deeper = paths.withColumn("segment", F.col("segments")[depth])
    branches = deeper.groupBy(*node, "segment").agg(
        F.sum("pages").alias("pages"), F.sum("good").alias("good"), F.sum("labels").alias("labels")
    )
    common = F.expr(f"pages >= {COMMON_PAGES} and pages * 100 >= {COMMON_SHARE} * all_pages")
    # squared z-score of a branch's share of good labels against that of its siblings
    rest_good, rest = F.expr("all_good - good"), F.expr("all_labels - labels")
    share = F.expr("cast(all_good as double) / all_labels")
    gap = F.col("good") / F.col("labels") - rest_good / rest
    spread = share * (F.lit(1.0) - share) * (F.lit(1.0) / F.col("labels") + F.lit(1.0) / rest)
    differs = F.when(
        (F.col("labels") > 0) & (rest > 0) & (spread > 0), gap * gap > F.lit(APART) * spread
    ).otherwise(False)
    totals = branches.groupBy(*node).agg(
        F.sum("pages").alias("all_pages"),
        F.sum("good").alias("all_good"),
        F.sum("labels").alias("all_labels"),
    )
    kept = (
        branches.join(totals, node)
        .where(common & differs)
        .select(*node, "segment", F.lit(True).alias("stays"))
    )
    step = F.when(F.col("stays"), F.col("segment")).otherwise(F.lit("*"))
    return deeper.join(kept, [*node, "segment"], "left").select(
        *[c for c in paths.columns if c != "template"],
        F.concat("template", F.lit("/"), step).alias("template"),
    )


def path_templates(pages: DataFrame) -> DataFrame:
    """host, segments and template of every masked path, from rows of host, segments and good (0, 1, null).

    Below a node of one path, or whose labels are all alike, no branch can differ: what is
    left of its paths is wildcards at once, so the levels end with the evidence.
    """
    paths = pages.groupBy("host", "segments").agg(
        F.count("*").alias("pages"),
        F.coalesce(F.sum("good"), F.lit(0)).alias("good"),
        F.count("good").alias("labels"),
    )
    now = store(paths.withColumn("template", F.lit("")), "paths")
    schema, closed, depth = now.schema, new_folder(pages.sparkSession, "closed-paths"), 0
    while True:
        deeper = F.size("segments") > depth
        nodes = now.where(deeper).groupBy("host", "template").agg(
            F.count("*").alias("n"), F.sum("good").alias("g"), F.sum("labels").alias("l")
        )
        mixed = store(
            nodes.where("n > 1 and g > 0 and g < l").select("host", "template", F.lit(True).alias("mixed")),
            "mixed-nodes",
        )
        marked = now.join(small_side(mixed), ["host", "template"], "left").withColumn(
            "open", deeper & F.col("mixed").isNotNull()
        )
        rest = F.expr(f"repeat('/*', greatest(size(segments) - {depth}, 0))")
        marked.where("not open").select(
            *[c for c in schema.names if c != "template"], F.concat("template", rest).alias("template")
        ).select(*schema.names).write.mode("append").parquet(closed)
        if mixed.isEmpty():
            return pages.sparkSession.read.schema(schema).parquet(closed)
        now = store(_level(marked.where("open").select(*schema.names), depth).select(*schema.names), "paths")
        depth += 1


def template_verdicts(paths: DataFrame) -> DataFrame:
    """host, template, its labels and its method verdict."""
    total = paths.agg(
        F.coalesce(F.sum("good"), F.lit(0)).alias("good"),
        F.coalesce(F.sum("labels"), F.lit(0)).alias("labels"),
    ).first()
    prior = total.good / total.labels if total.labels else 1.0
    sums = paths.groupBy("host", "template").agg(
        F.sum("good").alias("good"), F.sum("labels").alias("labels")
    )
    purity = (F.col("good") + F.lit(PRIOR * prior)) / (F.col("labels") + F.lit(PRIOR))
    return sums.withColumn(
        "template_verdict", F.when(purity < LEAST_GOOD, "block").otherwise("allow")
    )


def url_verdicts(pages: DataFrame, page_labels: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and template of every row of ``pages``.

    ``page_labels`` has ``name`` and ``good`` (0 or 1): the last number of a path is
    the name of what the page shows. Of several labels of a name the lowest counts,
    and labels without a name or value none. A null url, or one without ``://``, has
    an empty host and path, and so has its own template. Repeated rows are judged each
    by itself, a page without an id like any other; an empty table gives no rows; other
    columns are not read.
    """
    labels = (
        page_labels.where("name is not null and good is not null")
        .groupBy(F.col("name").cast("string").alias("name"))
        .agg(F.min("good").alias("good"))
    )
    cut = pages.select(
        F.col("page_id"), host_of().alias("host"), path_of().alias("path")
    ).select(
        "page_id", "host", "path", masked_segments().alias("segments"),
        F.regexp_extract("path", r"([0-9]+)[^0-9]*$", 1).alias("name"),
    )
    cut = store(cut, "pages")
    names = cut.where("name <> ''").select("host", "segments", "name")
    unnamed = cut.where("name = ''").select("host", "segments", F.lit(None).cast("int").alias("good"))
    good = names.join(labels, "name", "left").select(
        "host", "segments", F.col("good").cast("int").alias("good")
    )
    paths = path_templates(good.unionByName(unnamed))
    verdicts = template_verdicts(paths)
    judged = store(
        paths.select("host", "segments", "template").join(verdicts, ["host", "template"]),
        "templates",
    )
    ruled = [verdict for verdict, _ in rules]
    verdict_of = F.create_map(
        *[F.lit(x) for verdict, rule in rules for x in (rule, verdict)]
    )
    assert set(ruled) <= {"allow", "block"}
    return (
        cut.withColumn("rule", rule_of(rules))
        .join(judged, ["host", "segments"])
        .select(
            "page_id", "host", "path", "rule",
            F.coalesce(verdict_of[F.col("rule")], F.col("template_verdict")).alias("verdict"),
            "template", F.col("good").alias("template_good"),
            F.col("labels").alias("template_labels"),
        )
    )
