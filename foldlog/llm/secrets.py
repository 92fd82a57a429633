"""Secret scans: candidates by pattern, false positives removed by a random forest; DataFrame functions and MLlib alone.

Candidates are runs of at least 15 key-like characters, and what follows a key word and = or :, from 6 characters. The forest sees their
length, how their kinds of characters change, how much of them words of a dictionary cover, whether they look like a
path, and the words beside them; no format decides. It is trained on labelled findings (candidate, before, after, label).
Without a table of them, findings are planted: secrets of many issuers and look-alikes (hashes of commits, ids, paths, long
words, numbers, placeholders, data in texts), each in its contexts, labelled by what was planted. The dictionary is the corpus's own:
words that many documents hold.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldlog.llm.common import free_name, row_key
from foldlog.session import cut, keep

#: Findings of each label that the forest is trained on, at most; planted findings where none are given.
TRAIN_ROWS, PLANTED = 5_000, 8_000
TREES, DEPTH = 20, 8
MASK = "[SECRET]"
CHARS = "A-Za-z0-9+/_\\-"
KEY_WORD = r"(?i:passw(?:or)?d|pwd|secret|token|api[_-]?key|access[_-]?key)"
ASSIGN = "[\"']?\\s{0,2}[:=]\\s{0,2}[\"']?"
CANDIDATE = rf"{KEY_WORD}{ASSIGN}[^\s\"'<>,;]{{6,}}|(?<![{CHARS}])[{CHARS}]{{15,}}=?=?[{CHARS}]*(?![{CHARS}])"
#: What stands in front of the value in a candidate that holds its name too.
LEAD = rf"^[A-Za-z0-9_-]{{2,40}}{ASSIGN}(?=[^\s=:]{{6}})"
NEAR = r"(?i)(token|secret|passw(or)?d|pwd|api.?key|access.?key|auth|bearer|credential|private|aws)"
NAMING = r"(?i)\b(commit|sha\d*|hash|digest|checksum|uuid|guid|id|etag|version|rev|base64|file|path|order|number|example|sample|your)(\b|_)"
#: A word of the dictionary stands in so many documents at least, and in such a share of them.
DICTIONARY_DOCS, DICTIONARY_SHARE = 3, 1e-4
PIECES = r"\p{Lu}?\p{Ll}{2,}|\p{Lu}{3,}"
#: Elements of an array that are added up one by one, between sums of whole blocks.
BLOCK = 128
FEATURES = ["length", "changes", "digits", "uppers", "marks", "distinct", "hexadecimal", "covered", "path", "near_word", "naming", "assigned", "quoted", "prefixed"]


def running(lengths: Column, at: Column) -> Column:
    """The sum of the first `at` lengths: whole blocks first, then the rest of one, so that an array of n costs n * BLOCK."""
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    whole = F.floor(at / BLOCK).cast("int")
    return total(F.slice(lengths["blocks"], 1, whole)) + total(F.slice(lengths["each"], whole * BLOCK + 1, at - whole * BLOCK))


def candidates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, candidate, before, after): each candidate with what stands around it; start counts code points from 0.

    A text becomes an array of small structs, which alone is exploded: no candidate carries the text. Null and empty
    texts have none; texts of any length are scanned whole; repeated rows give their candidates each.
    """
    has = df.where(F.col(text_col).rlike(CANDIDATE)).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    parts = has.select("doc_id", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("c"), F.split("text", CANDIDATE, -1).alias("s"))
    each = F.transform("c", lambda c, i: F.char_length(c) + F.char_length(F.get("s", i)))
    parts = parts.withColumn("each", each).withColumn("blocks", F.transform(F.sequence(F.lit(0), F.floor(F.size("each") / BLOCK).cast("int")), lambda j: F.aggregate(F.slice("each", j * BLOCK + 1, F.lit(BLOCK)), F.lit(0), lambda a, x: a + x)))
    sums = {"each": F.col("each"), "blocks": F.col("blocks")}
    lead = lambda c: F.regexp_extract(c, LEAD, 0)
    made = lambda c, i: F.struct(
        (running(sums, i) + F.char_length(F.get("s", i)) + F.char_length(lead(c))).cast("long").alias("start"), F.substring(c, F.char_length(lead(c)) + 1, F.char_length(c)).alias("candidate"),
        F.right(F.concat(F.right(F.get("s", i), F.lit(40)), lead(c)), F.lit(40)).alias("before"), F.left(F.get("s", i + 1), F.lit(24)).alias("after"),
    )
    return parts.select("doc_id", F.explode(F.transform("c", made)).alias("x")).select("doc_id", "x.*")


def pieces(candidate: Column) -> Column:
    """The words that a candidate may be made of, lower-cased."""
    return F.transform(F.regexp_extract_all(candidate, F.lit(PIECES), F.lit(0)), lambda x: F.lower(x))


def dictionary(docs: DataFrame, wanted: DataFrame, text_col: str = "text") -> DataFrame:
    """(word): those of `wanted` (word) that enough documents of docs hold. Words are counted once a document."""
    told = docs.select(F.explode(F.array_distinct(F.split(F.lower(F.coalesce(text_col, F.lit(""))), r"[^\p{L}]+"))).alias("word")).where(F.char_length("word") >= 2)
    least = max(DICTIONARY_DOCS, int(docs.count() * DICTIONARY_SHARE))
    return told.groupBy("word").count().where(F.col("count") >= least).join(wanted.distinct(), "word", "left_semi").select("word")


def with_coverage(found: DataFrame, docs: DataFrame | None, text_col: str = "text") -> DataFrame:
    """found, kept, with `known`: how many characters of each candidate the corpus's dictionary covers; none without a corpus."""
    rows = keep(found.withColumn("finding", F.monotonically_increasing_id()))
    if docs is None:
        return rows.withColumn("known", F.lit(0).cast("long"))
    of = rows.select("finding", F.explode(pieces(F.coalesce("candidate", F.lit("")))).alias("word"))
    known = of.join(dictionary(docs, of.select("word"), text_col), "word").groupBy("finding").agg(F.sum(F.char_length("word")).alias("known"))
    return rows.join(known, "finding", "left").withColumn("known", F.coalesce("known", F.lit(0)))


def features(found: DataFrame) -> DataFrame:
    """Adds the features of each finding (candidate, before, after, known); nulls count as empty texts, and cover nothing."""
    c, before, after = (F.coalesce(F.col(x), F.lit("")) for x in ("candidate", "before", "after"))
    n = F.greatest(F.char_length(c), F.lit(1))
    share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / n
    changes = "(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])"
    made = {
        "length": n, "changes": share(changes), "digits": share("[0-9]"), "uppers": share("[A-Z]"), "marks": share("[^A-Za-z0-9]"),
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / n, "hexadecimal": c.rlike("^([0-9a-f]*|[0-9A-F]*)$").cast("int"), "covered": F.col("known") / n,
        "path": (c.rlike("/.*/") | before.rlike(r"(://|@|/)\S*$") | after.rlike(r"^(\.\w|@|/)")).cast("int"), "near_word": before.rlike(NEAR).cast("int"), "naming": F.concat(F.right(before, F.lit(20)), c).rlike(NAMING).cast("int"),
        "assigned": before.rlike(r"[=:]\s*[\"']?$").cast("int"), "quoted": (before.rlike("[\"']$") & after.rlike("^[\"']")).cast("int"), "prefixed": c.rlike("^[A-Za-z]{2,5}[_-]").cast("int"),
    }
    return found.withColumns({k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in made.items()})


def planted_findings(spark: SparkSession, n: int = PLANTED) -> DataFrame:
    """(finding_id, candidate, before, after, label): n made findings, half of them secrets; the same on every run."""
    mixed = F.sha2(F.concat(F.lit("finding-"), F.col("id").cast("string")), 512)
    rows = spark.range(n).select("id", mixed.alias("hex"), F.base64(F.unhex(mixed)).alias("b64"))
    rows = rows.withColumns({"alnum": F.regexp_replace("b64", "[^A-Za-z0-9]", ""), "letters": F.translate("hex", "0123456789abcdef", "ntrslaeioudmhcgw"), "figures": F.translate("hex", "abcdef", "012345"), "more": F.col("id") / 32 % 24})
    cut_at = lambda c, k: F.left(c, F.lit(k)) if isinstance(k, int) else F.left(c, k.cast("int"))
    longer = lambda k: F.lit(k) + F.col("more")
    url_safe, upper = F.translate("b64", "+/=", "-_"), F.upper("alnum")
    a_word = lambda at, k: F.substring("letters", at, k)
    uuid = F.concat_ws("-", *(F.substring("hex", at, k) for at, k in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    secret = [
        ('token = "', cut_at("hex", 40), '" '), ("and ", F.concat(F.lit("AKIA"), cut_at(upper, 16)), " "), ("api_key: ", cut_at(url_safe, longer(20)), "\n"), ("password=", cut_at("alnum", longer(8)), " "),
        ("Authorization: Bearer ", F.concat(F.lit("eyJ"), cut_at(url_safe, longer(30))), "."), ("the key ", F.concat(F.lit("sk_live_"), cut_at("alnum", 24)), " "), ("", F.concat(F.lit("ghp_"), cut_at("alnum", 36)), ""),
        ("secret: '", cut_at("hex", 32), "'"), ("aws_secret_access_key=", cut_at("b64", 40), ""), ("password: ", F.concat(a_word(1, 6), cut_at("figures", 3), F.lit("!")), ""), ('"api_key": "', cut_at("hex", longer(16)), '"'),
        ("pwd = ", cut_at("hex", longer(14)), " "), ("use ", F.concat(F.lit("xoxb-"), cut_at("figures", 11), F.lit("-"), cut_at("alnum", 20)), " now"), ("token=", cut_at("alnum", longer(18)), "&"), (" with ", cut_at("alnum", longer(28)), ", "), ("ID ", F.concat(F.lit("ASIA"), cut_at(upper, 16)), ". "),
    ]
    alike = [
        ("commit ", cut_at("hex", 40), "\n"), ("sha256: ", cut_at("hex", 64), " "), ("request id ", uuid, " "), (" ", cut_at("letters", longer(15)), " "), ("path /", F.concat(a_word(1, 4), F.lit("/"), a_word(5, 7), F.lit("/"), a_word(12, 8)), "/"),
        (" ", cut_at("figures", 16), " "), ('token = "', F.concat(F.lit("your_"), a_word(1, 7), F.lit("_here")), '"'), ("password: ", a_word(1, 9), " "), ("https://" , F.concat(a_word(1, 6), F.lit("-"), a_word(7, 8), F.lit("-"), a_word(15, 6)), ".com"),
        (". ", F.initcap(cut_at("letters", longer(15))), ", "), ("data:image/png;base64,", cut_at("b64", longer(40)), "..."), ("set ", F.upper(F.concat(a_word(1, 4), F.lit("_"), a_word(5, 6), F.lit("_"), a_word(11, 7))), " to"),
        ("order number ", cut_at("figures", longer(15)), ". "), (" ", F.upper(cut_at("letters", longer(15))), " "), ("call ", F.concat(a_word(1, 5), F.initcap(a_word(6, 7)), F.initcap(a_word(13, 6))), "("), ("the secret: ", a_word(3, 8), " of"),
    ]
    kinds = F.array(*(F.struct(F.lit(b).alias("before"), c.alias("candidate"), F.lit(a).alias("after"), F.lit(label).alias("label")) for label, of in ((1, secret), (0, alike)) for b, c, a in of))
    picked = rows.select("id", "letters", F.get(kinds, (F.col("id") % (len(secret) + len(alike))).cast("int")).alias("x"))
    told = F.concat(F.substring("letters", 30, 7), F.lit(" "), F.substring("letters", 40, 4), F.lit(" "), F.col("x.before"))
    return picked.select(F.col("id").alias("finding_id"), "x.candidate", F.right(told, F.lit(40)).alias("before"), F.concat("x.after", F.substring("letters", 50, 6)).alias("after"), F.col("x.label").alias("label"))


def trained(labelled: DataFrame, train_rows: int = TRAIN_ROWS):
    """A forest from (candidate, before, after, label, known), or None unless both labels are there. The sample is by hash."""
    parts = []
    for label in (0, 1):
        part = labelled.where(F.col("label") == label).select("candidate", "before", "after", "label", "known").distinct()
        parts.append(part.orderBy(F.xxhash64("candidate", "before", "after"), "candidate", "before", "after").limit(train_rows))
    rows = cut(features(reduce(DataFrame.unionByName, parts)).coalesce(1))
    if rows.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(labelCol="label", featuresCol="x", numTrees=TREES, maxDepth=DEPTH, seed=7)
    return forest.fit(VectorAssembler(inputCols=FEATURES, outputCol="x").transform(rows))


def scored(found: DataFrame, model) -> DataFrame:
    """Findings with `score`, the forest's probability that each is a secret; 0 without a forest."""
    if model is None:
        return found.withColumn("score", F.lit(0.0))
    seen = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(features(found))
    return model.transform(seen).withColumn("score", vector_to_array("probability")[1])


def secret_findings(df: DataFrame, labelled: DataFrame | None = None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, candidate, score, predicted): every candidate, with the forest's probability that it is a secret.

    labelled: findings (candidate, before, after, label) to train on; planted ones without it. Nulls and empty texts have no
    candidate. Texts of any length are scanned whole; each occurrence is a row, repeated rows too. With findings of one label
    alone every score is 0. Empty in, empty out. Extra columns are not carried.
    """
    found = with_coverage(candidates(df, id_col, text_col), df, text_col)
    given = planted_findings(df.sparkSession) if labelled is None else labelled
    model = trained(with_coverage(given.select("candidate", "before", "after", "label"), df, text_col))
    return scored(found, model).select(F.col("doc_id").alias(id_col), "start", "candidate", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def redact_secrets(df: DataFrame, labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """df with every found secret in `text` replaced by MASK, and n_chars, where there is such a column, counted anew.

    A secret is replaced wherever it stands in its row, a longer one before one that it holds. Rows are judged by id and
    text together, so null and repeated ids do no harm; no row is dropped; null, empty and clean texts are unchanged.
    Texts of any length are scanned whole; ties and repeated rows are treated alike. Columns of any name stay. Empty
    in, empty out.
    """
    row, hidden = free_name(df, "_row"), free_name(df, "_secrets")
    secrets = secret_findings(df.select(row_key().alias("row"), "text"), labelled, threshold, id_col="row").where("predicted = 1")
    longest_first = lambda found: F.transform(F.sort_array(F.collect_set(F.struct(F.char_length(found).alias("n"), found.alias("s"))), asc=False), lambda x: x["s"])
    of_row = secrets.groupBy(F.col("row").alias(row)).agg(longest_first(F.col("candidate")).alias(hidden))
    joined = df.withColumn(row, row_key()).join(of_row, row, "left")
    found = F.col(hidden).isNotNull()
    masked = F.aggregate(hidden, F.col("text"), lambda t, s: F.replace(t, s, F.lit(MASK)))
    joined = joined.withColumn("text", F.when(found, masked).otherwise(F.col("text")))
    if "n_chars" in df.columns:
        joined = joined.withColumn("n_chars", F.when(found, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return joined.select(*df.columns)
