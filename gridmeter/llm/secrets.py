"""Secret scan: candidates by pattern, false positives removed by a random forest.

DataFrame and SQL functions throughout; the forest is MLlib's, which runs in the JVM.
A candidate is the value after an assignment to a password, secret, token or key (what
stands in quotes, or up to white space), the password of user:pass@host, and besides a run
of key characters with a digit (8 and more) or a long run without (24 and more), whatever
stands before it.  The forest sees its length and shares of character classes, character
transitions (changes of class, and the mean log-probability of its letter pairs in
the words of the corpus), how much of it is dictionary words (words that the corpus has
``COMMON`` times), the path (what of a path or address it stands in, and what the
document's source says of tests or examples), and the words beside it.

It learns from labelled findings: ``labelled`` marks what a rule is sure of: an issuer's
prefix, an assignment to a password, token or key, or a login (1), digits alone, words, a
place in an address, or a value that only refers to another (0); assigned words that are
neither are left to the forest.  At most ``ROWS_PER_LABEL`` different candidates of each label are used, the
first by a hash; findings from elsewhere can be handed in instead.  The tables have no
labels for secrets, hence the rule.

Defined results: null and empty texts have no findings; rows that repeat id and text
count once; a null source is an empty path.  Without both labels in the sample there is
no forest: ``score`` is null, and ``secret`` follows the rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table, text_of

_KEY = r"A-Za-z0-9_+/\-"
_NAMES = r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|key|credential|auth)s?"
_GIVES = r"[\"']?\s{0,4}(?::=|=>|[:=])\s{0,4}"
#: an assigned value and the password of a login; cheap look-behinds stand first, so that few places try the long one
_QUOTED = rf"(?<=[\"'])(?<=(?i:{_NAMES}{_GIVES})[\"'])(?:(?<=\")[^\"\n]++(?=\")|(?<=')[^'\n]++(?=')|[^\s\"']++)"
_BARE = rf"(?<=[:=>\s])(?<=[:=>]\s{{0,4}})(?<=(?i:{_NAMES}{_GIVES}))[^\s\"'=:>,;)\]}}][^\s\"']*(?<![,;.)\]}}>])"
_LOGIN = r"(?<=[\w.%+\-/]:)[^\s/\"'<>@][^\s/\"'<>]{0,255}(?=@[\w\[.\-])"
CANDIDATE = rf"{_QUOTED}|{_BARE}|{_LOGIN}|(?<![{_KEY}])(?:(?=[A-Za-z_+/\-]*[0-9])[{_KEY}]{{8,}}|[{_KEY}]{{24,}})"
ISSUER = r"^(?:AKIA|ASIA|ghp_|gho_|xox[abp]-|sk_live_|AIza)[A-Za-z0-9_\-]{10,}$"
ASSIGNED = r"(?i)(?:pass(?:word|wd)?|pwd|secret|token|api[_-]?key|credential|auth)[\"']?\s*[:=]\s*[\"']?$"
#: any name that the value of a candidate is assigned to; names whose literal values are secrets; values that refer to another
NAMED = rf"(?i){_NAMES}{_GIVES}[\"']?$"
OWN = rf"(?i)(?:pass(?:word|wd|phrase)?|pwd|secret|credential)s?{_GIVES}[\"']?$"
REFERS = (r"(?i)^(?:null|none|nil|undefined|true|false|str(?:ing)?|int|bytes|bool(?:ean)?|any|optional|required)$|^\$\{?[a-z_]\w*\}?$|^\{.*\}?$|^<.*>?$"
          r"|^%[sd(]|^[\w.]+\(|^[*x.]+$|^(?:self|this|os|process|config|settings|env|request|args)\.")
ROWS_PER_LABEL, COMMON, TREES, DEPTH = 4000, 20, 24, 8
FEATURES = ["size", "digits", "upper", "lower", "hexa", "marks", "changes", "likely", "known", "in_path", "test_path", "keyword", "assigned", "quoted", "plain_after", "signs", "login"]


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """doc_id, row, n, start, cand, before, after, path: each candidate with what stands beside it."""
    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"), text_of(text_col).alias("t"))
    d = d.select("doc_id", "path", F.xxhash64("t").alias("row"), F.regexp_extract_all("t", F.lit(CANDIDATE), F.lit(0)).alias("c"), "t").where(F.size("c") > 0)
    parts = d.select("doc_id", "path", "row", "c", F.split("t", CANDIDATE, -1).alias("p"))
    one = F.transform("c", lambda x, i: F.struct(
        i.alias("n"), x.alias("cand"), F.right(F.concat(F.coalesce(F.get("c", i - 1), F.lit("")), F.element_at("p", i + 1)), F.lit(60)).alias("before"), F.left(F.element_at("p", i + 2), F.lit(40)).alias("after"),
        F.length(F.element_at("p", i + 1)).cast("bigint").alias("gap")))
    e = parts.select("doc_id", "path", "row", F.explode(one).alias("f")).select("doc_id", "path", "row", "f.*")
    e = e.dropDuplicates(["doc_id", "row", "n"])
    order = Window.partitionBy("doc_id", "row").orderBy("n")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    return e.select("doc_id", "row", "n", (F.sum(F.col("gap") + F.length("cand")).over(upto) - F.length("cand")).alias("start"), "cand", "before", "after", "path")


def share(c: str, kind: str) -> Column:
    return F.regexp_count(c, F.lit(f"[{kind}]")) / F.length(c)


def corpus_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, count) of all documents."""
    return (docs.select(F.explode(F.regexp_extract_all(F.lower(text_of(text_col)), F.lit(r"\p{L}{3,}"), F.lit(0))).alias("word"))
                .groupBy("word").agg(F.count(F.lit(1)).alias("count")))


def pairs(c: Column) -> Column:
    """The pairs of neighbouring letters and digits; anything else is one sign."""
    p = F.regexp_replace(F.lower(c), "[^a-z0-9]", "?")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(p) - 1, F.lit(1))), lambda i: F.substring(p, i, F.lit(2)))


def with_features(found: DataFrame, words: DataFrame) -> DataFrame:
    """``found`` with FEATURES; ``words``: (word, count), written."""
    pair = words.select(F.explode(pairs(F.col("word"))).alias("pair"), "count").groupBy("pair").agg(F.sum("count").alias("count"))
    first = Window.partitionBy(F.substring("pair", 1, 1))
    pair = pair.select("pair", F.log(F.col("count") / F.sum("count").over(first)).alias("log_p"))  # at most 37 * 37 rows
    cand = found.select("cand").distinct()
    likely = (cand.select("cand", F.explode(pairs(F.col("cand"))).alias("pair")).join(F.broadcast(pair), "pair", "left")
                  .groupBy("cand").agg(F.avg(F.coalesce("log_p", F.lit(-12.0))).alias("likely")))
    known = words.where(F.col("count") >= COMMON).select("word")
    known = (cand.select("cand", F.explode(F.regexp_extract_all(F.lower("cand"), F.lit(r"\p{L}{3,}"), F.lit(0))).alias("word")).join(known, "word")
                 .groupBy("cand").agg(F.sum(F.length("word")).alias("letters")))
    kinds = r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])"
    per = likely.join(known, "cand", "left").select(
        F.col("cand").alias("c"), "likely", (F.coalesce("letters", F.lit(0)) / F.length("cand")).alias("known"),
        F.length("cand").cast("double").alias("size"), share("cand", "0-9").alias("digits"), share("cand", "A-Z").alias("upper"),
        share("cand", "a-z").alias("lower"), share("cand", "0-9a-f").alias("hexa"), share("cand", r"_+/\-").alias("marks"), share("cand", rf"^{_KEY}").alias("signs"),
        (F.regexp_count("cand", F.lit(kinds)) / F.length("cand")).alias("changes"))
    flag = lambda c: c.cast("double")
    login = F.col("before").rlike(r"[\w.%+\-/]:$") & ~F.col("before").rlike(r"(?i)\b(?:mailto|e?-?mail|to|from|cc):$") & F.col("after").rlike(r"^@[\w\[.\-]")
    inside = F.col("before").rlike(r"[/.@:]$") | F.col("after").rlike(r"^(?:[/@]|\.\w)")
    return found.join(per, found["cand"] == per["c"]).drop("c").select(
        "*", flag(inside & ~login & ~F.col("before").rlike(NAMED)).alias("in_path"), flag(login).alias("login"),
        flag(F.col("path").rlike(r"(?i)test|example|sample|doc|mock")).alias("test_path"),
        flag(F.col("before").rlike(r"(?i)(?:pass|pwd|secret|token|key|auth|credential)\w*\W{0,6}$")).alias("keyword"),
        flag(F.col("before").rlike(r"[:=]\s*[\"']?$")).alias("assigned"), flag(F.col("before").rlike("[\"']$") & F.col("after").rlike("^[\"']")).alias("quoted"),
        flag(F.col("after").rlike(r"^[.,;]?(?:\s+\p{Ll}+|$)")).alias("plain_after"))


def labelled(f: DataFrame) -> DataFrame:
    """``f`` with ``label``: 1, 0, or null where the rule does not know."""
    named, own, refers = F.col("before").rlike(NAMED), F.col("before").rlike(OWN), F.col("cand").rlike(REFERS)
    login, quoted, digits = F.col("login") == 1, F.col("quoted") == 1, F.col("digits") > 0
    yes = F.col("cand").rlike(ISSUER) | ~refers & (
        F.col("before").rlike(ASSIGNED) & digits & (F.col("known") < 0.5) & (F.col("size") >= 8)
        | own & (F.col("size") >= 6) & (digits | quoted) & ~F.col("cand").rlike(r"\s")
        | login & F.col("before").rlike(r"://[^\s/@\"']*:$") & (digits | (F.col("known") < 0.5)))
    words = (F.col("known") >= 0.5) | F.col("cand").rlike(r"^[A-Za-z\-_]+[0-9]{0,4}$")
    no = (refers | ~named & ~login & ((F.col("digits") == 1) | words | (F.col("in_path") == 1))
          | named & ~quoted & words & (F.col("plain_after") == 1) & ~digits | named & ~own & (F.col("digits") == 1) & (F.col("size") < 8))
    return f.withColumn("label", F.when(yes, 1.0).when(no, 0.0))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", known: DataFrame | None = None) -> DataFrame:
    """doc_id, n, start, length, cand, score, secret of every candidate.

    ``known``: findings with FEATURES and label to learn from, instead of the rule's.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    found = materialize(findings(docs, id_col, text_col, path_col), "findings")
    words = materialize(corpus_words(docs, text_col), "words")
    f = materialize(labelled(with_features(found, words)), "features")
    sure = (known if known is not None else f).where("label IS NOT NULL")
    pick = [sure.where(F.col("label") == k).groupBy("cand").agg(*[F.max(c).alias(c) for c in [*FEATURES, "label"]])
                .orderBy(F.xxhash64("cand"), "cand").limit(ROWS_PER_LABEL) for k in (0.0, 1.0)]
    sample = materialize(pick[0].union(pick[1]), "labelled").coalesce(1).sortWithinPartitions("label", "cand")
    out = ["doc_id", "n", "start", F.length("cand").alias("length"), "cand"]
    if sample.select("label").distinct().count() < 2:
        return f.select(*out, F.lit(None).cast("double").alias("score"), (F.coalesce("label", F.lit(0.0)) == 1).alias("secret"))
    join = VectorAssembler(inputCols=FEATURES, outputCol="features")
    model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=7).fit(join.transform(sample))
    score = vector_to_array("probability")[1]
    return model.transform(join.transform(f)).select(*out, score.alias("score"), (score >= 0.5).alias("secret"))


def op3_secrets(spark, sf_dir):
    """Every candidate of every document with its score; the text of a secret stays in its document."""
    return scan(table(spark, sf_dir, "documents")).select("doc_id", "n", "start", "length", F.sha2("cand", 256).alias("cand_sha256"), "score", "secret")
