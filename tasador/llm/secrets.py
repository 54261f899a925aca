"""Secret scan: candidates in texts, and a random forest that removes false positives.

DataFrame functions and the JVM's random forest only. A candidate is a run of
at least ``LEAST_LENGTH`` letters, digits and ``+/_-`` inside a word (a piece
between white space), or the whole value assigned to a secret's name (in quotes, or up to white
space) or standing as the password in an address, from ``LEAST_ASSIGNED`` characters of any kind. A run inside such
a value is a candidate too; it is left out of the result where all its places are inside found values. Its features:

* length, shares of digits, upper-case letters and marks, entropy of characters;
* transitions: how often the kind of character changes, and how likely its
  neighbouring letters follow each other in the words of the corpus;
* dictionary coverage: the share of its characters in runs of letters that are
  words of the corpus (found ``WORD_COUNT`` times or more, counted over all
  texts);
* path: whether the word around it looks like an address, a path or a mail address;
* neighbouring words: whether what stands before it in its word, or one of the two words
  before, names a secret, and whether an assignment or a quote stands before it.

The forest learns from labelled findings of two kinds. ``reviewed`` is a table of findings as reviewers
meet them, ``REVIEWED_ROWS`` of them: keys, passwords and bearer tokens at names of secrets, issued formats,
and the false positives of the same shapes: commit ids, checksums, UUIDs, content hashes, embedded
images, names of bundled files, settings that are named and not given. To these come candidates of the
corpus, ``TRAIN_ROWS`` at most, chosen by a hash, that ``known_label`` is sure of: formats that issuers define, and
assignments to names of secrets with a random value, are true; runs of letters only, plain numbers, words
joined by marks, and parts of addresses are false; all others have no label. A caller's own table of
reviewed findings takes the place of both. A short value without any digit at a secret's name is
learned to be a setting (``token: expired``), so such passwords are not found.

A candidate that stands at several places of a text is judged at each of them, and the highest score counts.

Rows: null and empty texts have no candidates; candidates that repeat inside a text
count once; a row repeated with id and text is treated like the row it repeats;
without labels of both kinds every labelled true candidate is a secret and
nothing else; an empty table gives an empty result; extra columns are carried along.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tasador.llm.linededup import with_text
from tasador.llm.splits import bounded_sample
from tasador.plans.lineage import cut_lineage, fresh_path

LEAST_LENGTH = 16
LEAST_ASSIGNED = 6
WORD_COUNT = 5
TRAIN_ROWS = 20_000
REVIEWED_ROWS = 6_000
TREES = 20
DEPTH = 6
MASK = "[SECRET]"

CANDIDATE = r"[A-Za-z0-9+/_-]{16,}"
SECRET_NAMES = r"(?i)(passw|pwd|secret|token|api.?key|access.?key|private.?key|credential|auth|bearer)"
_NAMED = SECRET_NAMES.replace("(passw", "(?:passw").replace("auth", "auth(?!or)") + r"[\w.-]{0,24}"
# names before a value: 1 and 2 in the query of an address, else 3 and the value 4 in double, 5 in single, 6 in no quotes
ASSIGNED = (
    rf"([?&][\w.-]{{0,30}}?{_NAMED}=)([^\s&#\"']{{{LEAST_ASSIGNED},}})"
    rf"|({_NAMED}(?<![?&][\w.-]{{0,60}})[\"'\]]{{0,2}}[ \t]{{0,3}}(?:=>|:=|==?|:)[ \t]{{0,3}})"
    rf"(?:\"([^\"\n]{{{LEAST_ASSIGNED},}})\"|'([^'\n]{{{LEAST_ASSIGNED},}})'"
    rf"|([^\s\"'][^\s\"]{{{LEAST_ASSIGNED - 2},}}[^\s\"',;.)\]}}>]))"
)
USER_PASSWORD = rf"(://[^\s/:@\"'<>]{{0,64}}:)(?!\d{{1,5}}[?#])([^\s/\"'<>]{{{LEAST_ASSIGNED},}})(?=@[A-Za-z0-9\[])"
ISSUED = (
    r"^(AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_[A-Za-z0-9]{36,}$|^xox[abprs]-[A-Za-z0-9-]{10,}$|^sk_(live|test)_[A-Za-z0-9]{16,}$"
    r"|^AIza[A-Za-z0-9_-]{35}$|^eyJ[A-Za-z0-9_-]{16,}$"
)
ADDRESS = r"(?i)(://|^www\.|@[a-z0-9-]+\.|^/[^/]+/|\.(html?|php|png|jpe?g)\b)"
FEATURES = (
    "length digits upper marks entropy changes follow covered address named assigned quoted issued".split()
)

# shape of the value, what stands before it, and whether it is a secret; shapes are worked out in ``reviewed``
REVIEWED = [
    *[(shape, before, 1) for shape in ("hex40", "hex64", "mixed32", "uuid", "url43") for before in (
        'token = "', "API_KEY=", "secret_key: ", 'client_secret": "', "private-key = '", "the access_key = ", "auth_token: ",
    )],
    *[("url43", before, 1) for before in ("Authorization: Bearer=", "bearer: ")],
    *[(shape, before, 1) for shape in ("short9", "short12", "mixed32") for before in ("password=", 'passwd = "', "db pwd: ", "://user:")],
    *[(shape, before, 1) for shape in ("akia", "ghp", "sklive") for before in ("use ", "key ", 'id = "', "see: ")],
    *[(shape, before, 0) for shape in ("hex40", "hex64", "hex32") for before in (
        "commit ", "in commit ", "sha256: ", "md5 checksum ", 'sha1 = "', 'etag: "', "revision=", "digest ", "blob ", "fixed by ",
    )],
    *[("uuid", before, 0) for before in ("request id ", 'uuid = "', "session ", "job: ", "trace=", "device ")],
    *[("base64", before, 0) for before in ("data:image/png;base64,", 'integrity="sha384-', "url(data:font/woff2;base64,")],
    *[("file", before, 0) for before in ("load ", "js/", 'src="', "chunk: ")],
    *[("minified", before, 0) for before in ("var ", "function ", "return ", "call ")],
    *[("digits", before, 0) for before in ("order ", "id: ", "at=", "phone ")],
    *[("setting", before, 0) for before in ("token: ", "password=", 'api_key = "', "secret: ", "auth = ", "the token ")],
]


def _row_keys() -> list[Column]:
    return [F.xxhash64("doc_id", "text").alias("r1"), F.xxhash64(F.lit("row"), "text", "doc_id").alias("r2")]


def _runs(rows: DataFrame) -> DataFrame:
    """r1, r2, whole, value, before (in its word, and two words) and word of every run in a column ``text``."""
    words = F.split("text", r"\s+")
    hits = F.filter(
        F.transform("_words", lambda w, i: F.struct(i.alias("i"), w.alias("word"))),
        lambda x: (F.length(x["word"]) >= LEAST_LENGTH) & x["word"].rlike(CANDIDATE),
    )
    found = (
        rows.where(F.col("text").rlike(CANDIDATE))
        .select("r1", "r2", "whole", words.alias("_words"))
        .select("r1", "r2", "whole", "_words", F.explode(hits).alias("hit"))
    )
    # for the first words of a text fewer words stand before
    start = F.greatest(F.col("hit.i") - 1, F.lit(1))
    before = F.array_join(F.slice("_words", start, F.least(F.col("hit.i"), F.lit(2))), " ")
    # what stands between the candidates of a word is one piece more than these
    split = found.select(
        "r1",
        "r2",
        "whole",
        F.col("hit.word").alias("word"),
        before.alias("words_before"),
        F.regexp_extract_all("hit.word", F.lit(f"({CANDIDATE})")).alias("values"),
        F.split("hit.word", CANDIDATE, -1).alias("between"),
    )
    pairs = F.zip_with("between", "values", lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    places = F.transform(
        "values",
        lambda v, i: F.struct(
            v.alias("value"), F.concat(F.array_join(F.slice(pairs, F.lit(1), i), ""), F.get("between", i)).alias("inside")
        ),
    )
    each = split.select("r1", "r2", "whole", "word", "words_before", F.explode(places).alias("x"))
    context = F.concat_ws(" ", "words_before", "x.inside").alias("before")
    return each.select("r1", "r2", "whole", F.col("x.value").alias("value"), context, "word")


def _values(rows: DataFrame) -> DataFrame:
    """r1, r2, value, before and word of every value assigned to a name and of every password in an address."""

    def assigned(m: Column) -> Column:
        part = {g: F.regexp_extract(m, ASSIGNED, g) for g in range(1, 7)}
        quote = F.when(part[4] != "", '"').when(part[5] != "", "'").otherwise("")
        return F.struct(
            F.concat(part[2], part[4], part[5], part[6]).alias("value"),
            F.concat(part[1], part[3], quote).alias("before"),
            m.alias("word"),
        )

    def password(m: Column) -> Column:
        part = [F.regexp_extract(m, r"(?s)^(://[^:]*:)(.*)$", g) for g in (1, 2)]
        return F.struct(part[1].alias("value"), part[0].alias("before"), F.concat(m, F.lit("@")).alias("word"))

    found = [
        F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), one)
        for pattern, one in ((ASSIGNED, assigned), (USER_PASSWORD, password))
    ]
    told = rows.where(F.col("text").rlike(SECRET_NAMES) | F.col("text").contains("://"))
    told = told.select("r1", "r2", F.explode(F.concat(*found)).alias("x"))
    return told.select("r1", "r2", "x.*").where(F.length("value") >= LEAST_ASSIGNED)


def candidates(docs: DataFrame) -> DataFrame:
    """Distinct candidates and surroundings in every text: r1, r2, whole, value, before, word.

    ``whole`` is the assigned value that a run is inside of, null for all others.
    """
    rows = docs.where(F.col("text").isNotNull()).select(*_row_keys(), "text")
    values = _values(rows)
    outside = F.when(F.col("text").contains("://"), F.regexp_replace("text", USER_PASSWORD, "$1 ")).otherwise(F.col("text"))
    outside = F.when(F.col("text").rlike(SECRET_NAMES), F.regexp_replace(outside, ASSIGNED, "$1$3 ")).otherwise(outside)
    parts = values.where(F.col("value").rlike(CANDIDATE) & ~F.col("value").rlike(f"^{CANDIDATE}$"))
    parts = _runs(parts.select("r1", "r2", F.col("value").alias("whole"), F.concat("before", "value").alias("text")))
    none = F.lit(None).cast("string").alias("whole")
    found = _runs(rows.select("r1", "r2", none, outside.alias("text")))
    own = ["r1", "r2", "whole", "value", "before", "word"]
    values = values.select("r1", "r2", none, "value", "before", "word")
    return found.select(own).unionByName(parts.select(own)).unionByName(values).distinct()


def dictionary(docs: DataFrame, count: int = WORD_COUNT) -> DataFrame:
    """Words of three letters or more that occur ``count`` times in all texts: word, n."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{3,15})(?![a-z])"))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= count)


def letter_steps(words: DataFrame) -> Column:
    """A map from two neighbouring letters to the log of their share: 26 x 26 entries at most."""
    pair = F.explode(
        F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(2)))
    )
    counts = words.select(pair.alias("pair"), "n").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    total = sum(row["n"] for row in counts)
    entries = [x for row in counts for x in (F.lit(row["pair"]), F.log(F.lit(row["n"] / total)))]
    return F.create_map(*entries) if entries else F.create_map(F.lit(""), F.lit(0.0))


def with_features(found: DataFrame, words: DataFrame) -> DataFrame:
    """Candidates with the columns in ``FEATURES``."""
    value, length = F.col("value"), F.length("value")

    def share(pattern: str) -> Column:
        return (length - F.length(F.regexp_replace(value, pattern, ""))) / length

    kinds = F.regexp_replace(
        F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0"), "[^aA0]", "-"
    )
    runs = F.length(F.regexp_replace(kinds, r"(.)\1+", "$1"))
    each = F.array_distinct(F.split(value, ""))
    part = lambda c: (length - F.length(F.replace(value, c, F.lit("")))) / length
    entropy = F.aggregate(
        F.filter(each, lambda c: c != ""), F.lit(0.0), lambda s, c: s - part(c) * F.log2(part(c))
    )
    lowered = F.lower(value)
    pairs = F.filter(
        F.transform(F.sequence(F.lit(1), length - 1), lambda i: F.substring(lowered, i, F.lit(2))),
        lambda p: p.rlike("^[a-z]{2}$"),
    )
    steps = letter_steps(words)
    unlikely = -12.0
    told = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + F.coalesce(F.try_element_at(steps, p), F.lit(unlikely)))
    follow = F.when(F.size(pairs) > 0, told / F.size(pairs)).otherwise(unlikely)
    shaped = found.select(
        "*",
        length.cast("double").alias("length"),
        share("[0-9]").alias("digits"),
        share("[A-Z]").alias("upper"),
        share("[A-Za-z0-9]").alias("_alnum"),
        entropy.alias("entropy"),
        ((runs - 1) / (length - 1)).alias("changes"),
        follow.alias("follow"),
        F.col("word").rlike(ADDRESS).cast("double").alias("address"),
        F.col("before").rlike(f"{SECRET_NAMES}|://[^\\s/:@]*:$").cast("double").alias("named"),
        F.col("before").rlike(r"[=:]\s*[\"']?$").cast("double").alias("assigned"),
        F.col("before").rlike(r"[\"']$").cast("double").alias("quoted"),
        value.rlike(ISSUED).cast("double").alias("issued"),
    ).withColumn("marks", 1 - F.col("_alnum"))
    shaped = cut_lineage(shaped.drop("_alnum"), "shaped")
    runs_of_letters = (
        shaped.select("value").distinct().select(
            "value", F.explode(F.regexp_extract_all(F.lower("value"), F.lit("([a-z]{3,})"))).alias("word")
        )
    )
    covered = (
        runs_of_letters.join(words.select("word"), "word")
        .groupBy("value")
        .agg((F.sum(F.length("word")) / F.first(F.length("value"))).alias("covered"))
    )
    return shaped.join(covered, "value", "left").withColumn("covered", F.least(F.coalesce("covered", F.lit(0.0)), F.lit(1.0)))


def known_label() -> Column:
    """1 for candidates in an issuer's format or assigned to a secret's name, 0 for plainly harmless ones, else null."""
    value = F.col("value")
    random = value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.col("entropy") >= 2.5)
    named = (F.col("named") == 1) & (F.col("assigned") == 1) & random & ~value.rlike(r"\s")
    joined = value.rlike(r"^[A-Za-z]*([-_/+][A-Za-z]*)*$") | value.rlike(r"^[0-9]+([-_/+][0-9]+)*$")
    return F.when(value.rlike(ISSUED) | named, 1).when(joined | (F.col("address") == 1), 0).cast("int")


def reviewed(spark: SparkSession, words: DataFrame, rows: int = REVIEWED_ROWS) -> DataFrame:
    """``rows`` labelled findings with their features, made by rule from REVIEWED: the same ones every time."""
    digest = lambda salt: F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    hexa, more = digest("a"), digest("b")
    base64 = F.replace(F.base64(F.unhex(F.concat(hexa, more))), F.lit("\r\n"), F.lit(""))
    plain = F.regexp_replace(base64, "[+/=]", "")
    part = lambda c, start, n: F.substring(c, start, n)
    settings = "required expired missing optional changeme disabled config.service_account os.environ.get settings_value".split()
    names = "getElementsByTagName addEventListenerOnce encodeURIComponentList createDocumentFragment".split()
    one_of = lambda texts: F.get(F.array(*[F.lit(t) for t in texts]), F.pmod(F.xxhash64("id"), F.lit(len(texts))).cast("int"))
    shapes = {
        "hex32": part(hexa, 1, 32),
        "hex40": part(hexa, 1, 40),
        "hex64": hexa,
        "mixed32": part(plain, 1, 32),
        "uuid": F.concat_ws("-", part(hexa, 1, 8), part(hexa, 9, 4), part(hexa, 13, 4), part(hexa, 17, 4), part(hexa, 21, 12)),
        "url43": F.translate(part(base64, 1, 43), "+/", "-_"),
        "short9": F.concat(part(plain, 1, 7), F.lit("7!")),
        "short12": F.concat(part(plain, 1, 6), F.lit("#4"), part(plain, 9, 4)),
        "akia": F.concat(F.lit("AKIA"), F.upper(part(plain, 1, 16))),
        "ghp": F.concat(F.lit("ghp_"), part(plain, 1, 36)),
        "sklive": F.concat(F.lit("sk_live_"), part(plain, 1, 24)),
        "base64": part(base64, 1, 64),
        "file": F.concat(one_of(["main-", "vendor-", "chunk_", "app-bundle-"]), part(hexa, 1, 20)),
        "minified": F.concat(one_of(names), F.pmod(F.col("id"), F.lit(90)).cast("string")),
        "digits": F.concat(F.lit("20"), part(F.translate(hexa, "abcdef", "012345"), 1, 16)),
        "setting": one_of(settings),
    }
    kinds = F.array(*[F.struct(F.lit(s).alias("shape"), F.lit(b).alias("before"), F.lit(y).alias("label")) for s, b, y in REVIEWED])
    told = spark.range(rows).withColumn("kind", F.get(kinds, F.pmod(F.col("id"), F.lit(len(REVIEWED))).cast("int")))
    value = F.coalesce(*[F.when(F.col("kind.shape") == s, c) for s, c in shapes.items()])
    told = told.select(value.alias("value"), "kind.before", "kind.label")
    last = F.element_at(F.split("before", r"\s"), -1)
    word = F.concat(last, "value", F.when(F.col("before").startswith("://"), F.lit("@")).otherwise(""))
    return with_features(told.withColumn("word", word), words)


def scored(shaped: DataFrame, findings: DataFrame | None = None, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Candidates with the forest's probability as ``score``.

    ``findings`` are reviewed candidates with the columns of ``with_features``
    and ``label``, all of which are learned from; without them ``known_label`` labels a sample of the candidates.
    """
    if findings is None:
        known = shaped.withColumn("label", known_label())
        known = known.where(F.col("label").isNotNull()).withColumn("_id", F.xxhash64("value", "before"))
        findings = bounded_sample(known, "_id", train_rows)
    sample = cut_lineage(findings.select(*FEATURES, "label"), "findings")
    kinds = {row["label"] for row in sample.select("label").distinct().collect()}
    if kinds != {0, 1}:
        return shaped.withColumn("score", F.coalesce((known_label() == 1).cast("double"), F.lit(0.0)))
    gather = VectorAssembler(inputCols=FEATURES, outputCol="_features")
    forest = RandomForestClassifier(
        featuresCol="_features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=17, probabilityCol="_probability"
    ).fit(gather.transform(sample))
    # read back without its training summary, which holds the session and cannot be sent to tasks
    path = fresh_path(shaped.sparkSession, "forest")
    forest.save(path)
    forest = RandomForestClassificationModel.load(path)
    told = forest.transform(gather.transform(shaped))
    return told.withColumn("score", vector_to_array("_probability")[1]).drop(
        "_features", "rawPrediction", "_probability", "prediction"
    )


def findings(docs: DataFrame, accept: float = 0.5) -> DataFrame:
    """Per row (r1, r2): number of candidates and the secrets among them, by falling length."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    words = cut_lineage(dictionary(source), "dictionary")
    shaped = cut_lineage(with_features(candidates(source), words), "candidates")
    sure = shaped.withColumn("label", known_label())
    sure = sure.where(F.col("label").isNotNull()).withColumn("_id", F.xxhash64("value", "before"))
    known = bounded_sample(sure, "_id", TRAIN_ROWS).select(*FEATURES, "label")
    told = scored(shaped, known.unionByName(reviewed(docs.sparkSession, words).select(*FEATURES, "label")))
    told = told.groupBy("r1", "r2", "value").agg(
        F.max("score").alias("score"), F.max(F.col("whole").isNull()).alias("alone"), F.collect_set("whole").alias("wholes")
    )
    held = F.when(~F.col("alone"), F.col("wholes")).otherwise(F.array().cast("array<string>")).alias("wholes")
    secret = F.when(F.col("score") >= accept, F.struct((-F.length("value")).alias("n"), "value", "score", held))
    rows = told.groupBy("r1", "r2").agg(
        F.count(F.lit(1)).alias("n_candidates"), F.sort_array(F.collect_list(secret)).alias("_found")
    )
    values = F.transform("_found", lambda x: x["value"])
    told_by = lambda x: (F.size(x["wholes"]) > 0) & (F.size(F.array_except(x["wholes"], values)) == 0)
    bare = F.transform(F.filter("_found", lambda x: ~told_by(x)), lambda x: F.struct(x["n"], x["value"], x["score"]))
    rows = rows.select("r1", "r2", "n_candidates", bare.alias("found"))
    return cut_lineage(rows, "secrets")


def scan_documents(docs: DataFrame, accept: float = 0.5) -> DataFrame:
    """doc_id, n_candidates, n_secrets and the secrets (value, score) of every document."""
    found = findings(docs, accept)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.select("doc_id", *_row_keys()).join(found, ["r1", "r2"], "left")
    kind = "array<struct<value:string,score:double>>"
    secrets = F.coalesce(F.transform("found", lambda x: F.struct(x["value"], x["score"])), F.array().cast(kind))
    return rows.select(
        "doc_id",
        F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"),
        F.size(secrets).cast("long").alias("n_secrets"),
        secrets.cast(kind).alias("secrets"),
    )


def without_secrets(docs: DataFrame, accept: float = 0.5, mask: str = MASK) -> DataFrame:
    """The documents, all columns, with every found secret replaced by ``mask``, longer ones first."""
    found = findings(docs, accept).select("r1", "r2", F.col("found"))
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
    )
    rows = packed.select("_doc", "text", *_row_keys()).join(found, ["r1", "r2"], "left")
    masked = F.aggregate("found", F.col("text"), lambda t, s: F.replace(t, s["value"], F.lit(mask)))
    rows = rows.withColumn("_masked", F.when(F.size("found") > 0, masked).otherwise(F.col("text")))
    return rows.select(*with_text("_doc", docs.columns, F.col("_masked")))
