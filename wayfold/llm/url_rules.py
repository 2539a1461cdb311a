"""URL filters: fixed rules by host and path, and association rules mined from labels for all other URLs.

A fixed rule fits its host and every subdomain, if the path starts with the rule's; the
longest wins.  For the rest, the tokens of the URLs of pages labelled bad are mined by
Spark's FP-growth for frequent combinations; a combination's confidence is its share of bad
pages among all labelled pages that hold it.  Combinations below the support or confidence
thresholds are pruned, and so are those that a shorter one makes needless.  A page meets the
mined rules through an inverted index: each rule is filed under its rarest token, so a page
looks up its tokens and only then checks whole combinations.

DataFrame functions only on the main path.  Pages with the same tokens are judged once
(grouped with a map side), so a hot host costs one row per distinct token set.

Defined cases: a null URL, or one without ``://``, has an empty host and path, no rule and no
tokens, and is allowed; without labelled pages nothing is mined; of several labels of a page a
bad one counts; repeated rows are judged each; extra columns are not read.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import ascii_lower

# Fixed values: (verdict, host, path) of the base rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Least share of the bad pages, least number of them, and least confidence of a mined rule: the lower end of
#: Wilson's interval (DEVIATES standard deviations) must pass it, so that few pages prove little.
SUPPORT, PAGES, CONFIDENCE, DEVIATES = 0.01, 5, 0.5, 2.0


def sure(bad: Column, known: Column) -> Column:
    """The lower end of the interval around bad / known."""
    z2 = DEVIATES * DEVIATES
    share = bad / known
    return (share + z2 / (2 * known) - DEVIATES * F.sqrt((share * (1 - share) + z2 / (4 * known)) / known)) / (1 + z2 / known)


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return ascii_lower(rest)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fixed_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct of verdict and rule; null where none does.  One projection."""
    best = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        best = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule_host + rule_path).alias("rule"))).otherwise(best)
    return best


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL: scheme, host labels, path parts, file ending, query names."""
    marked = lambda array, mark: F.transform(F.filter(array, lambda x: x != ""), lambda x: F.concat(F.lit(mark), x))
    lower = ascii_lower(F.coalesce(url, F.lit("")))
    scheme = F.regexp_extract(lower, r"(?s)^(.*?)://", 1)
    query = F.regexp_extract(lower, r"(?s)\?([^#]*)", 1)
    names = F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, r"(?s)^([^=]*)", 1))
    every = F.concat(marked(F.array(scheme), "s:"), marked(F.split(host, r"\."), "h:"), marked(F.split(ascii_lower(path), "/"), "p:"),
                     marked(F.array(F.regexp_extract(ascii_lower(path), r"\.([a-z0-9]{1,5})$", 1)), "e:"), marked(names, "q:"))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(every)))


def mine(labelled: DataFrame, support: float = SUPPORT, pages: int = PAGES, confidence: float = CONFIDENCE) -> DataFrame:
    """rule (sorted tokens), bad, known and confidence from rows of (tokens, bad).

    FP-growth runs over the bad pages alone; the pages that hold a found combination are then counted
    over all labelled pages, through the same index that judging uses.
    """
    model = FPGrowth(itemsCol="tokens", minSupport=support, minConfidence=1.0).fit(labelled.where(F.col("bad") & (F.size("tokens") > 0)).select("tokens"))
    frequent = (model.freqItemsets.where((F.col("freq") >= pages) & (F.size("items") > 0))
                .select(F.array_sort("items").alias("rule"), F.col("freq").alias("bad")))
    sets = labelled.groupBy("tokens").agg(F.count(F.lit(1)).alias("n"))
    known = matches(sets, frequent.select("rule")).groupBy("rule").agg(F.sum("n").alias("known"))
    rules = (frequent.join(known, "rule").withColumn("confidence", sure(F.col("bad"), F.col("known")))
             .where(F.col("confidence") >= confidence))
    # a rule is needless if a shorter one inside it is at least as sure
    shorter = rules.select(F.col("rule").alias("tokens"), F.col("confidence").alias("c"))
    inside = (matches(shorter, rules.select("rule", "confidence"))
              .where((F.size("rule") < F.size("tokens")) & (F.col("confidence") >= F.col("c")))
              .select(F.col("tokens").alias("rule")).distinct())
    return rules.join(inside, "rule", "left_anti")


def matches(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows of ``sets`` (column tokens) with each rule (column rule) whose tokens they all hold.

    The inverted index files a rule under its token of fewest rules, so that few rules share an entry.
    """
    filed = rules.select(F.struct("*").alias("r"), F.explode("rule").alias("token"))
    often = filed.groupBy("token").agg(F.count(F.lit(1)).alias("often"))
    index = (filed.join(often, "token").groupBy("r").agg(F.min(F.struct("often", "token")).alias("key"))
             .select(F.col("key.token").alias("token"), "r"))
    asked = sets.select(F.struct("*").alias("row"), F.explode("tokens").alias("token"))
    return (asked.join(index, "token").where(F.size(F.array_except(F.col("r.rule"), F.col("row.tokens"))) == 0)
            .select("row.*", "r.*"))


def judge(pages: DataFrame, labels: DataFrame | None = None, rules=RULES, id_col: str = "page_id", url: str = "url",
          label_id: str = "doc_id", bad: Column | None = None) -> DataFrame:
    """Per page: id, host, path, rule, verdict, and the mined rule that blocked it.

    A label belongs to the page of the same id; ``bad`` says over its columns whether it speaks against
    the page, by default low quality or toxicity.
    """
    bad = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False)) if bad is None else bad
    read = pages.select(F.col(id_col).alias("page_id"), F.col(url).alias("url")).withColumns(
        {"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    cut = read.withColumns({"tokens": tokens(F.col("url"), F.col("host"), F.col("path")),
                            "fixed": fixed_rule(F.col("host"), F.col("path"), rules)})
    marks = labels.select(F.col(label_id).alias("page_id"), bad.alias("bad")).groupBy("page_id").agg(F.max("bad").alias("bad"))
    mined = mine(cut.select("page_id", "tokens").join(marks, "page_id").select("tokens", "bad"))
    hits = (matches(cut.where(F.col("fixed").isNull()).select("tokens").distinct(), mined)
            .groupBy("tokens").agg(F.max(F.struct("confidence", "bad", "rule")).alias("hit")))
    return (cut.join(hits, "tokens", "left")
            .select("page_id", "host", "path", F.col("fixed.rule").alias("rule"),
                    F.coalesce(F.col("fixed.verdict"), F.when(F.col("hit").isNotNull(), F.lit("block")), F.lit("allow")).alias("verdict"),
                    F.when(F.col("fixed").isNull(), F.array_join("hit.rule", " ")).alias("mined_rule")))
