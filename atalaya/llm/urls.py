"""URL filter: rules first, then a tree of path templates per host. DataFrame functions only.

1. Hosts and paths are cut out of the urls; the longest fitting rule decides where one fits.
2. Every path becomes a template. Runs of digits in a segment are wildcards at once, so pages
   collapse to few (host, path) leaves with counts before anything else. On those leaves, level by
   level, a segment is also a wildcard when its parent has many branches and the segment
   holds few of the parent's pages.
3. Sibling templates of the same depth and of a similar rate of blocked pages are merged.
4. A template is rejected when its smoothed share of blocked pages, among pages that a rule labelled,
   reaches `reject_at`. The smoothing pulls templates with few labels to the share over all labels.

Defined results: a null url, or one without `://`, has an empty host and path, no rule, and is allowed
unless the template of the empty host is rejected; an empty table gives an empty result; rows that repeat are
judged each on its own and alike; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atalaya.runtime import materialize

#: (verdict, host, path). A rule fits its host and all subdomains.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

#: Levels of a path that branch; what lies deeper is one more level.
LEVELS = 3
#: A parent with more branches than this has its small branches made wildcards,
MANY_BRANCHES = 16
#: where small is under one page in this many of the parent's pages.
SMALL_BRANCH = 50
#: Labels that the share over all labels counts for.
SMOOTHING = 4
#: Siblings are merged when their smoothed shares fall into the same of this many steps.
RATE_STEPS = 5
REJECT_AT = 0.8
#: Parts of each key in the join of pages with templates.
SALTS = 16

_SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _SPLIT, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _SPLIT, 2), F.lit(""))


def _first_rule(host: Column, path: Column, rules: list[tuple[str, str, str]], of) -> Column:
    """`of(rule)` of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == rule[1]) | host.endswith("." + rule[1])) & path.startswith(rule[2])
        out = F.when(fits, F.lit(of(rule))).otherwise(out)
    return out


def with_rules(pages: DataFrame, rules: list[tuple[str, str, str]], *, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """page_id, host, path, rule and the rule's verdict, from a short list of rules."""
    url = F.col(f"`{url_column}`").cast("string")
    cut = pages.select(F.col(f"`{id_column}`").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    host, path = F.col("host"), F.col("path")
    return cut.select(
        "page_id", "host", "path",
        _first_rule(host, path, rules, lambda r: r[1] + r[2]).alias("rule"),
        _first_rule(host, path, rules, lambda r: r[0]).alias("ruled"),
    )


def path_leaf(path: Column) -> Column:
    """The path with runs of digits as wildcards, without a slash at its end."""
    return F.regexp_replace(F.regexp_replace(path, r"[0-9]+", "*"), r"/+$", "")


def template_tree(leaves: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Leaves (host, leaf, n, labelled, bad) with their `parent` template and their own `template`."""
    segments = F.split(F.col("leaf"), "/")
    tree = leaves.withColumn("template", F.lit("")).withColumn("parent", F.lit("")).withColumn("depth", F.size(segments) - 1)
    for level in range(1, levels + 2):
        last = level == levels + 1
        own = F.array_join(F.slice(segments, F.lit(level + 1), F.size(segments)), "/") if last else F.get(segments, level)
        tree = tree.withColumn("segment", F.when(F.col("depth") >= level, own))
        branches = tree.where(F.col("segment").isNotNull()).groupBy("host", "template", "segment").agg(F.sum("n").alias("pages"))
        parents = branches.groupBy("host", "template").agg(F.count(F.lit(1)).alias("branches"), F.sum("pages").alias("all_pages"))
        small = (F.col("branches") > MANY_BRANCHES) & (F.col("pages") * SMALL_BRANCH < F.col("all_pages"))
        named = branches.join(parents, ["host", "template"]).select(
            "host", "template", "segment", F.when(small, F.lit("*")).otherwise(F.col("segment")).alias("name")
        )
        # Each level is written: the next one reads it three times.
        tree = materialize(
            tree.join(named, ["host", "template", "segment"], "left")
            .withColumn("parent", F.when(F.col("segment").isNull(), F.col("parent")).otherwise(F.col("template")))
            .withColumn("template", F.when(F.col("segment").isNull(), F.col("template")).otherwise(F.concat_ws("/", "template", "name")))
            .drop("segment", "name"),
            "templates",
        )
    return tree


def rejected_templates(tree: DataFrame, prior: float, *, reject_at: float = REJECT_AT) -> DataFrame:
    """host, template and whether it is rejected, after merging similar siblings."""
    share = lambda bad, labelled: (F.col(bad) + SMOOTHING * prior) / (F.col(labelled) + SMOOTHING)
    templates = tree.groupBy("host", "parent", "template", "depth").agg(
        F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")
    ).withColumn("step", F.floor(share("bad", "labelled") * RATE_STEPS))
    merged = templates.groupBy("host", "parent", "depth", "step").agg(
        F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad")
    )
    return templates.join(merged, ["host", "parent", "depth", "step"]).select(
        "host", "parent", "template", "depth", (share("all_bad", "all_labelled") >= reject_at).alias("rejected")
    )


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, **columns: str) -> DataFrame:
    """page_id, host, path, rule, verdict and template of every page."""
    ruled = with_rules(pages, rules, **columns).withColumn("leaf", path_leaf(F.col("path")))
    leaves = ruled.groupBy("host", "leaf").agg(
        F.count(F.lit(1)).alias("n"), F.count("ruled").alias("labelled"),
        F.count(F.when(F.col("ruled") == "block", 1)).alias("bad"),
    )
    leaves = materialize(leaves, "leaves")
    totals = leaves.agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")).first()
    prior = totals["bad"] / totals["labelled"] if totals["labelled"] else 0.0
    tree = template_tree(leaves)
    judged = tree.join(rejected_templates(tree, prior), ["host", "parent", "template", "depth"]).select(
        "host", "leaf", "template", "rejected"
    )
    # A host may have a third of all pages: each key is cut into parts, the judged leaf goes to every part.
    salted = ruled.withColumn("_salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)))
    spread = judged.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    verdict = F.coalesce("ruled", F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow")))
    return salted.join(spread, ["host", "leaf", "_salt"]).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template")


def oracle(rules: list[tuple[str, str, str]] = RULES) -> str:
    """The same in SQL, without salts, over the table `pages`."""
    ordered = sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2]), reverse=True)
    cases = lambda k: " ".join(
        f"WHEN (host = '{r[1]}' OR ends_with(host, '.{r[1]}')) AND starts_with(path, '{r[2]}') THEN '{r[0] if k else r[1] + r[2]}'" for r in ordered
    )
    steps = ["""t0 AS (SELECT *, '' AS template, '' AS parent, len(string_split(leaf, '/')) - 1 AS depth FROM leaves)"""]
    for level in range(1, LEVELS + 2):
        own = f"array_to_string(string_split(leaf, '/')[{level + 1}:], '/')" if level == LEVELS + 1 else f"string_split(leaf, '/')[{level + 1}]"
        steps.append(f"""
s{level} AS (SELECT *, CASE WHEN depth >= {level} THEN {own} END AS segment FROM t{level - 1}),
b{level} AS (SELECT host, template, segment, sum(n) AS pages FROM s{level} WHERE segment IS NOT NULL GROUP BY ALL),
n{level} AS (SELECT *, CASE WHEN count(*) OVER w > {MANY_BRANCHES} AND pages * {SMALL_BRANCH} < sum(pages) OVER w THEN '*' ELSE segment END AS name
  FROM b{level} WINDOW w AS (PARTITION BY host, template)),
t{level} AS (SELECT s.host, s.leaf, s.n, s.labelled, s.bad, s.depth,
  CASE WHEN s.segment IS NULL THEN s.parent ELSE s.template END AS parent,
  CASE WHEN s.segment IS NULL THEN s.template ELSE s.template || '/' || b.name END AS template
  FROM s{level} s LEFT JOIN n{level} b ON s.host = b.host AND s.template = b.template AND s.segment = b.segment)""")
    share = lambda bad, n: f"(({bad} + {SMOOTHING} * prior) / ({n} + {SMOOTHING}))"
    return f"""
WITH cut AS (SELECT page_id, translate(coalesce(regexp_extract(url, '{_SPLIT}', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
  coalesce(regexp_extract(url, '{_SPLIT}', 2), '') AS path FROM pages),
ruled AS (SELECT *, CASE {cases(0)} END AS rule, CASE {cases(1)} END AS ruled,
  regexp_replace(regexp_replace(path, '[0-9]+', '*', 'g'), '/+$', '') AS leaf FROM cut),
leaves AS (SELECT host, leaf, count(*) AS n, count(ruled) AS labelled, count(*) FILTER (ruled = 'block') AS bad FROM ruled GROUP BY ALL),
prior AS (SELECT coalesce(sum(bad) / nullif(sum(labelled), 0), 0) AS prior FROM leaves),
{", ".join(steps)},
templates AS (SELECT host, parent, template, depth, sum(labelled) AS labelled, sum(bad) AS bad, any_value(prior) AS prior
  FROM t{LEVELS + 1}, prior GROUP BY host, parent, template, depth),
stepped AS (SELECT *, floor({share('bad', 'labelled')} * {RATE_STEPS}) AS step FROM templates),
merged AS (SELECT *, {share('sum(bad) OVER w', 'sum(labelled) OVER w')} >= {REJECT_AT} AS rejected FROM stepped
  WINDOW w AS (PARTITION BY host, parent, depth, step)),
judged AS (SELECT t.host, t.leaf, t.template, m.rejected FROM t{LEVELS + 1} t JOIN merged m USING (host, parent, template, depth))
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN rejected THEN 'block' ELSE 'allow' END) AS verdict, template
FROM ruled JOIN judged USING (host, leaf)"""
