"""Secret scans with a random forest that removes false positives, on DataFrame functions alone.

Candidates are (a) runs of at least ``SHORTEST`` characters of keys and hashes that hold a digit and a letter, wherever
they stand; (b) what begins as issued keys do, with or without a digit; (c) whatever follows a word such as "password"
and a sign of assignment, in the same token or in the next one, of any length and with any characters.
Each is described by its length, its make-up, the transitions between classes of characters, how much of it dictionary
words cover, the path it stands under and the words beside it. The dictionary is a short list of stand-ins and the
most frequent words of all texts, counted for each scan. A random forest (MLlib) trained on labelled findings
decides. ``labelled_findings`` gives a deterministic labelled set; teams pass their own triaged findings instead.
A secret of fewer characters than ``SHORTEST``, or without a digit, that nothing introduces is no candidate.
Redaction cuts a secret where it was found, in its token, and nothing else: the same characters elsewhere stay.

Defined results: null text has no findings; null ids, sources and neighbours are allowed; repeated rows give repeated
findings; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of the shortest candidate that nothing introduces.
SHORTEST = 12
_RUN = rf"[A-Za-z0-9+/_-]{{{SHORTEST},}}={{0,2}}"
#: A token with such a run and a digit in it: the cheap test that texts and tokens must pass first.
_MAYBE = rf"(?=[A-Za-z0-9+/_-]{{{SHORTEST}}})[A-Za-z+/_-]*[0-9]"
#: Words that stand in for a secret, whatever the corpus; what the dictionary covers of a candidate speaks against it.
DICTIONARY = (
    "example", "sample", "dummy", "changeme", "placeholder", "password", "secret", "token", "test", "demo", "your", "here",
    "image", "page", "file", "index", "article", "section", "version", "release", "document", "user", "name", "data",
    "the", "and", "for", "with", "from", "ing", "tion", "ment", "lich", "keit", "ando",
)
#: Words of the corpus that join the dictionary: the most frequent ones of so many letters that occur so often at least.
WORDS, LETTERS, OFTEN = 1_000, (4, 12), 100
#: Words before a secret, and words before what only looks like one.
HINTS = r"passw|passwd|pwd|secret|token|api.?key|apikey|access.?key|auth|bearer|credential|private"
DECOYS = r"commit|sha|md5|hash|checksum|digest|uuid|guid|revision|build|order|invoice|isbn|serial|ticket|etag|example|sample"
#: Paths under which findings are mostly made up.
FAKE_PATHS = r"test|example|sample|fixture|mock|docs?/|demo"
#: Fixed beginnings of issued keys.
ISSUED = r"^(AKIA|ASIA|ghp_|gho_|xox[abp]-|sk_live_|sk-|AIza|glpat-|npm_)"
_ISSUED_RUN = r"((?<![A-Za-z0-9_-])(?:AKIA|ASIA|ghp_|gho_|xox[abp]-|sk_live_|sk-|AIza|glpat-|npm_)[A-Za-z0-9_-]{8,})"
#: A hint and a sign of assignment: before the value in its own token, and at the end of the two tokens before it.
_INLINE = rf"(?i)(?:{HINTS})[\w.-]*[\"']?(?:[:=]+>?)[\"']?([^\s:=>\"'].*)$"
_LEADING = rf"(?i)(?:{HINTS})[\w.-]*[\"']?\s?(?:[:=]+>?|is)[\"']?$|(?i)bearer$"
_EDGES = r"^[\"'(\[]+|[\"'][^A-Za-z0-9]*$|[\"',;.)\]]+$"
FEATURES = (
    "length", "digits", "uppers", "hex", "transitions", "case_changes", "digit_changes", "distinct", "covered", "slashes",
    "symbols", "lower_only", "issued", "hint", "decoy", "assigned", "fake_path", "neighbour_digits",
)


def corpus_words(docs: DataFrame, text_col: str = "text") -> list[str]:
    """The ``WORDS`` most frequent words of all texts (lower-case Latin letters), ties by spelling: a list of bounded length."""
    text = F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    words = docs.select(F.explode(F.split(text, "[^a-z]+")).alias("word")).where(F.length("word").between(*LETTERS))
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= OFTEN)
    return [r.word for r in counted.orderBy(F.desc("n"), "word").limit(WORDS).collect()]


def described(found: DataFrame, words: tuple[str, ...] = DICTIONARY) -> DataFrame:
    """Add the features. Columns needed: value, before (the words before), after, path. ``words`` is the dictionary; longer words cover first."""
    low = F.lower("value")
    kinds = F.translate("value", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "a" * 26 + "A" * 26 + "0" * 10)
    size = F.length("value").cast("double")
    spelt = "|".join(sorted(words, key=lambda w: (-len(w), w)))
    flag = lambda test: test.cast("double")
    before = F.coalesce(F.lower("before"), F.lit(""))
    return found.withColumns(
        {
            "length": size,
            "digits": F.length(F.regexp_replace("value", "[^0-9]", "")) / size,
            "uppers": F.length(F.regexp_replace("value", "[^A-Z]", "")) / size,
            "hex": flag(F.col("value").rlike("^[0-9a-f]+$")),
            "transitions": (F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")) - 1) / size,
            "case_changes": F.regexp_count(kinds, F.lit("a(?=A)|A(?=a)")) / size,
            "digit_changes": F.regexp_count(kinds, F.lit("[aA](?=0)|0(?=[aA])")) / size,
            "symbols": F.length(F.regexp_replace("value", "[A-Za-z0-9]", "")) / size,
            "lower_only": flag(F.col("value").rlike(r"^\p{Lu}?\p{Ll}+$")),
            "distinct": F.size(F.array_distinct(F.split("value", ""))) / size,
            "covered": 1 - F.length(F.regexp_replace(low, spelt, "")) / size,
            "slashes": F.length(F.regexp_replace("value", "[^/]", "")).cast("double"),
            "issued": flag(F.col("value").rlike(ISSUED)),
            "hint": flag(before.rlike(HINTS)),
            "decoy": flag(before.rlike(DECOYS)),
            "assigned": flag(before.rlike(_LEADING)),
            "fake_path": flag(F.coalesce(F.lower("path"), F.lit("")).rlike(FAKE_PATHS)),
            "neighbour_digits": flag(F.concat(before, F.lit(" "), F.coalesce("after", F.lit(""))).rlike("[0-9]")),
        }
    )


def labelled_findings(spark: SparkSession, n: int = 8_000) -> DataFrame:
    """A labelled set made by rule: value, before, after, path, label. Positives are keys and passwords as they are issued, negatives look like them."""
    i = F.col("id")
    kind = i % 20
    md5, sha = F.md5(i.cast("string")), F.sha2(F.concat(F.lit("s"), i.cast("string")), 256)
    upper = F.upper(F.translate(F.substring(F.base64(F.unhex(sha)), 1, 24), "+/=abcdefghij", "XYZ2345672345"))
    mixed = F.substring(F.translate(F.base64(F.unhex(sha)), "+/=", "abc"), 1, 36)
    pick = lambda *options: F.get(F.array(*[F.lit(x) for x in options]), (F.pmod(F.xxhash64("id"), F.lit(len(options)))).cast("int"))
    word = pick("the of", "der und", "de la", "que los", "is and", "en un", "to a")
    short = F.substring(mixed, 1, 5 + (F.pmod(F.xxhash64("id"), F.lit(7))).cast("int"))
    spelt = F.translate(F.substring(sha, 1, 32), "0123456789", "ghijklmnop")
    made_up = F.translate(F.substring(md5, 1, 3 + (F.pmod(F.hash("id"), F.lit(9))).cast("int")), "0123456789", "eiouaenrst")
    sign = pick("!", "#", "$", "&", "@", "%", "*")
    value = (
        F.when(kind == 0, F.concat(F.lit("AKIA"), F.substring(upper, 1, 16)))
        .when(kind == 1, F.substring(md5, 1, 18))
        .when(kind == 2, F.substring(sha, 1, 40))
        .when(kind == 3, F.concat(F.lit("ghp_"), mixed))
        .when(kind == 4, mixed)
        .when(kind == 5, F.substring(sha, 3, 32))
        .when(kind == 6, F.substring(sha, 1, 40))
        .when(kind == 7, F.concat_ws("-", F.substring(md5, 1, 8), F.substring(md5, 9, 4), F.substring(md5, 13, 4), F.substring(md5, 17, 4), F.substring(md5, 21, 12)))
        .when(kind == 8, F.concat(pick("your-api-key-here-", "example-token-", "changeme-password-"), F.substring(md5, 1, 2)))
        .when(kind == 9, F.concat(pick("article/2024/page-", "images/file_name_", "release-version-"), (i % 97).cast("string")))
        .when(kind == 10, md5)
        .when(kind == 12, F.concat(short, sign, F.substring(mixed, 20, 3)))
        .when(kind == 13, F.when(i % 3 == 0, F.upper(spelt)).otherwise(spelt))
        .when(kind == 14, F.concat(F.lit("AKIA"), F.translate(F.substring(upper, 1, 16), "0123456789", "KLMNOPQRST")))
        .when(kind == 15, F.concat(pick("hunter", "dragon", "Tr0ub", "P@ss", "monkey", "Sommer"), (i % 97).cast("string"), sign, pick("correct", "horse", "w0rd", "dor", "x")))
        .when(kind == 16, F.when(F.floor(i / 20) % 2 == 0, F.concat(pick("hunter", "secure", "Winter", "admin", "qwertz"), (i % 997).cast("string"), F.upper(F.substring(md5, 1, 1)))).otherwise(F.translate(F.substring(md5, 1, 8), "abcdef", "123456")))
        .when(kind == 17, pick("required", "optional", "none", "true", "false", "null", "expired", "missing", "invalid", "string", "hidden", "empty", "correct", "wrong", "needed", "stored", "secret", "not"))
        .when(kind == 18, F.when(i % 3 == 0, F.initcap(made_up)).otherwise(made_up))
        .when(kind == 19, pick("<password>", "<your-token>", "${TOKEN}", "$PASSWORD", "xxxxxxxx", "********", "YOUR_API_KEY", "/etc/app/token.txt", "https://example.com/login", "{{secret}}", "...", "os.environ"))
        .otherwise(F.concat(F.lit("AKIA"), pick("EXAMPLE", "SAMPLE", "DUMMY"), F.lit("KEY00000")))
    )
    before = (
        F.when(kind == 0, F.when(F.floor(i / 20) % 5 == 0, F.lit("aws_access_key_id =")).otherwise(word))
        .when(kind == 1, F.concat(word, F.lit(" password=")))
        .when(kind == 2, F.concat(word, F.lit(" token =")))
        .when(kind == 3, word)
        .when(kind == 4, F.concat(word, pick(" api_key:", " secret =", " auth bearer", " private credential")))
        .when(kind == 5, F.concat(word, pick(" secret:", " passwd=", " access-key")))
        .when(kind == 6, F.concat(word, pick(" commit", " sha1", " digest of", " revision")))
        .when(kind == 7, F.concat(word, pick(" uuid", " guid =", " order", "")))
        .when(kind == 10, F.concat(word, pick(" md5", " checksum:", " etag", " hash")))
        .when(kind == 14, F.when(F.floor(i / 20) % 5 == 0, F.lit("aws_access_key_id =")).otherwise(word))
        .when((kind == 12) | (kind == 13) | (kind >= 15), F.concat(word, pick(" password=", " password:", " secret:", " token =", " pwd:", " auth:", " passwd =", " api_key=", " password is")))
        .otherwise(F.concat(word, pick(" token =", "", " password:")))
    )
    path = F.when((kind == 11) | (i % 29 == 0), pick("src/test/data", "docs/example", "fixtures/mock")).otherwise(F.concat(F.lit("src"), (i % 20).cast("string")))
    return spark.range(n).select(value.alias("value"), before.alias("before"), word.alias("after"), path.alias("path"), ((kind < 6) | kind.between(12, 16)).cast("double").alias("label"))


def train(findings: DataFrame, trees: int = 24, depth: int = 7, words: tuple[str, ...] = DICTIONARY) -> RandomForestClassificationModel:
    """A random forest on labelled findings (value, before, after, path, label)."""
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(described(findings.where("value is not null and label is not null"), words))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7).fit(rows.select("features", "label"))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """(doc_id, text_key, token_no, start, value, before, after, path): every candidate of every whole text.

    ``start`` is the place of the value in its token, from 0; what a token holds as a run, perhaps twice, has -1.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(path_col).cast("string").alias("path"), text.alias("text"))
    some = F.col("text").rlike(_MAYBE) | F.col("text").rlike(f"(?i){HINTS}") | F.col("text").rlike(_ISSUED_RUN)
    cut = plain.where(some).select("doc_id", "path", F.md5(F.encode("text", "UTF-8")).alias("text_key"), F.split("text", r"\s+").alias("tokens"))
    before = lambda i: F.array_join(F.slice("tokens", F.greatest(i - 1, F.lit(1)), F.least(i, F.lit(2))), " ")
    led = lambda i: (F.get("tokens", i - 1).rlike(r"[:=>\"']$|(?i)^is$|bearer$")) & before(i).rlike(_LEADING)
    held = lambda token: token.rlike(_MAYBE) | token.rlike(_ISSUED_RUN) | token.rlike(_INLINE)
    places = F.filter(F.sequence(F.lit(0), F.size("tokens") - 1), lambda i: held(F.get("tokens", i)) | ((i > 0) & led(i)))
    # One row per candidate carries the few tokens around it, not the text.
    around = F.transform(
        places,
        lambda i: F.struct(
            i.alias("token_no"),
            F.get("tokens", i).alias("token"),
            F.array_join(F.slice("tokens", F.greatest(i - 2, F.lit(1)), F.least(i, F.lit(3))), " ").alias("before"),
            F.get("tokens", i + 1).alias("after"),
            F.when((i > 0) & led(i), F.get("tokens", i)).otherwise(F.regexp_extract(F.get("tokens", i), _INLINE, 1)).alias("given"),
        ),
    )
    one = cut.select("doc_id", "path", "text_key", F.explode(around).alias("x")).select("doc_id", "path", "text_key", "x.*")
    # What is given ends with its token; the signs around it are not part of it.
    opening = F.length(F.regexp_extract("given", r"^([\"'(\[]*)", 1))
    one = one.withColumn("at", F.length("token") - F.length("given") + opening)
    one = one.withColumn("given", F.nullif(F.regexp_replace("given", _EDGES, ""), F.lit("")))
    runs = F.filter(F.regexp_extract_all("token", F.lit(f"({_RUN})"), F.lit(1)), lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]"))
    runs = F.concat(runs, F.regexp_extract_all("token", F.lit(_ISSUED_RUN), F.lit(1)))
    # What a longer value holds is part of it.
    apart = F.filter(runs, lambda v: F.col("given").isNull() | ~F.contains(F.col("given"), v))
    placed = F.concat(
        F.transform(F.array_distinct(apart), lambda v: F.struct(v.alias("value"), F.lit(-1).alias("start"))),
        F.when(F.col("given").isNull(), F.array().cast("array<struct<value:string,start:int>>")).otherwise(F.array(F.struct(F.col("given").alias("value"), F.col("at").alias("start")))),
    )
    one = one.withColumn("x", F.explode(placed)).select("*", "x.value", "x.start")
    head = F.when(F.col("start") >= 0, F.expr("substring(token, 1, start)")).otherwise(F.expr("substring_index(token, value, 1)"))
    return one.select("doc_id", "text_key", "token_no", "start", "value", F.concat_ws(" ", "before", head).alias("before"), "after", "path")


def scan(docs: DataFrame, findings: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """One row per candidate: doc_id, text_key, token_no, start, value, score, is_secret."""
    words = tuple(dict.fromkeys((*DICTIONARY, *corpus_words(docs, text_col))))
    model = train(labelled_findings(docs.sparkSession) if findings is None else findings, words=words)
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(described(candidates(docs, id_col, text_col, path_col), words))
    scored = model.transform(rows).withColumn("score", F.get(vector_to_array("probability"), 1))
    return scored.select("doc_id", "text_key", "token_no", "start", "value", "score", (F.col("score") >= 0.5).alias("is_secret"))


def redact(docs: DataFrame, text: Column, secrets: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with the secrets cut out of ``text`` where they were found. ``secrets`` is ``secrets_by_text``; equal texts share them."""
    found = secrets.select(F.col("text_key").alias("__key"), F.col("places").alias("__places"))
    joined = docs.withColumn("__key", F.md5(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))).join(found, "__key", "left")
    # A text is its tokens, each with the blanks before it; blanks before the first count as an empty token of their own.
    parts = F.regexp_extract_all(text, F.lit(r"(\s*\S+|\s+\z)"), F.lit(1))
    joined = joined.withColumns({"__parts": F.when(F.col("__places").isNotNull(), parts), "__shift": text.rlike(r"^\s").cast("int")})
    joined = joined.select("*", F.aggregate("__places", F.struct(F.lit("").alias("done"), F.lit(0).alias("at")), lambda acc, x: _cut_next(acc, x, mark)).alias("__cut"))
    rest = F.array_join(F.slice("__parts", F.col("__cut.at") + 1, F.size("__parts")), "")
    return joined.withColumn("__text", F.when(F.col("__places").isNull(), text).otherwise(F.concat("__cut.done", rest))).drop("__key", "__places", "__parts", "__shift", "__cut")


def _cut_next(done: Column, place: Column, mark: str) -> Column:
    """Take up the parts before the next token with secrets, and this token without them."""
    no = place["token_no"] - F.col("__shift")
    part = F.get(F.col("__parts"), no)
    token = F.regexp_extract(part, r"^\s*(\S*)", 1)
    blanks = F.substring(part, F.lit(1), F.length(part) - F.length(token))
    # The place in the token comes last in it, so it is cut first; then what stands before it as runs.
    cut = F.aggregate(
        place["cuts"],
        token,
        lambda t, x: F.when(x["start"] < 0, F.replace(t, x["value"], F.lit(mark))).otherwise(
            F.concat(F.substring(t, F.lit(1), x["start"]), F.lit(mark), F.substring(t, x["start"] + F.length(x["value"]) + 1, F.length(t)))
        ),
    )
    before = F.array_join(F.slice(F.col("__parts"), done["at"] + 1, no - done["at"]), "")
    return F.struct(F.concat(done["done"], before, blanks, cut).alias("done"), (no + 1).alias("at"))


def secrets_by_text(found: DataFrame) -> DataFrame:
    """(text_key, places): of each text the tokens that hold secrets, in order, with what to cut there: given places first, then longer runs before shorter ones."""
    own = found.where("is_secret").select("text_key", "token_no", "start", "value").distinct()
    tokens = own.groupBy("text_key", "token_no").agg(F.sort_array(F.collect_list(F.struct(-F.col("start"), -F.length("value"), F.col("start").alias("start"), F.col("value").alias("value")))).alias("cuts"))
    cuts = F.transform("cuts", lambda x: F.struct(x["start"].alias("start"), x["value"].alias("value")))
    return tokens.groupBy("text_key").agg(F.sort_array(F.collect_list(F.struct("token_no", cuts.alias("cuts")))).alias("places"))
