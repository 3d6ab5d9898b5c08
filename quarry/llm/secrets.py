"""Secret scans: candidates by pattern, judged by a random forest, all in SQL expressions."""

from __future__ import annotations

import re

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import discard, materialize, packed_row, unpacked_row

#: Names before a secret, and names before what only looks like one.
SECRET_WORDS = "password|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth|credential|bearer|client[_-]?secret"
HARMLESS_WORDS = "commit|sha|md5|checksum|digest|hash|uuid|guid|version|revision|rev|build|isbn|card|phone|order|invoice|etag|trace|request|session[_-]?id|example|sample|placeholder|dummy|serial|ref"
#: Beginnings that name the issuer of a key.
KNOWN_PREFIXES = "AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|xox[abprs]-|sk-|sk_live_|rk_live_|AIza|ya29|glpat-|npm_|eyJ"
#: Frequent English and programming words; letters that they cover count as
#: dictionary coverage. Another list may be given instead.
DICTIONARY = (
    "the and for with that from this have change example password secret token name test user value data file path "
    "get set key your here lib usr home src main index page image config build local linux string http https www com "
    "org net html json class function return null none true false default place holder sample dummy insert redacted "
    "about access account action active add address admin after all any api app apply array base before begin body "
    "book box button call case check client code color column command comment common connect content control copy "
    "count create current custom date day debug delete demo detail device direct display doc document domain down "
    "download edit email enable end engine error event exchange export factory field filter find first folder form "
    "format forest garden general global group handle head header hello help history host icon info input install item language "
    "last layer letter level library line link list load log login long make manager map market master media member "
    "memory menu message method mode model module more most name nation new next node number object open option order other "
    "package paper parent part people platform play point port post print process product profile project public query read "
    "reading remote report request result river room root route run save scale schema script search send server service "
    "session silver simple site size source start state station status store style system table target task template text "
    "theory thing time title tool top total type under update upload url version view walk water web window word work world year"
).split()
#: A private key: to its end mark, or else the lines of base64 after its head.
#: A line's end may be written as \\n. Loops over groups are possessive, in which
#: the regular expressions of the JVM do not recurse, so a key may be of any length.
PRIVATE_KEY = (
    r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY(?: BLOCK)?-----"
    r"(?:[^-]*+(?:-{1,4}(?!-)[^-]*+)*+-----END [A-Z ]{0,30}PRIVATE KEY(?: BLOCK)?-----"
    r"|(?:\s++[A-Za-z-]{3,30}: [^\n]*+)*+(?:(?:\s|\\[nr])++[A-Za-z0-9+/]{16,}+={0,2})*+(?:(?:\s|\\[nr])++[A-Za-z0-9+/]{2,}+={1,2})?)"
)
#: What may be a secret: a named value, a token of parts joined by dots, a long
#: run with a digit, a long run of capitals, or a private key.
CANDIDATE = (
    r"(?i:(?:" + SECRET_WORDS + r")[\"']?\s{0,3}[:=]\s{0,3}[\"']?(?!-----BEGIN )[^\s\"'<>]{5,}[^\s\"'<>,;])"
    r"|(?<![A-Za-z0-9+/_-])eyJ[A-Za-z0-9_-]{5,}(?:\.[A-Za-z0-9_-]+){2,4}"
    r"|(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}={0,2}"
    r"|(?<![A-Za-z0-9+/_-])[A-Z0-9]{16,}(?![a-z])"
    r"|" + PRIVATE_KEY
)
FEATURES = ("length", "digits", "uppers", "lowers", "others", "changes", "distinct", "vowels", "coverage", "hex", "numeric", "slashes", "known", "named", "near_secret", "near_harmless", "after_harmless", "in_url", "test_path", "config_path")
#: Neighbouring words are those that begin or end within so many code points on either side.
NEAR = 80
#: Parts of paths of examples and tests, and of settings and keys.
TEST_PATHS = "test|spec|example|sample|fixture|mock|demo|doc|readme|locale|node_modules|vendor|\\.lock|\\.svg"
CONFIG_PATHS = "\\.env|config|settings|secret|credential|\\.pem|\\.key|\\.ini|\\.ya?ml|\\.properties|\\.tfvars|id_rsa|\\.netrc"
THRESHOLD = 0.5
TREES, DEPTH, SEED, FINDINGS = 25, 7, 11, 6000


def _sql(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _features(value: str, whole: str, left: str, right: str, path: str, words: list[str]) -> str:
    """SQL of the feature struct of one candidate; the arguments but the last are SQL expressions."""
    n = f"greatest(length({value}), 1)"
    share = lambda cls: f"regexp_count({value}, {_sql(cls)}) / {n}"
    flag = lambda text, rx: f"cast({text} rlike {_sql(rx)} as double)"
    around = f"concat({left}, {whole})"
    covered = "(?i)" + "|".join(sorted(set(words), key=lambda w: (-len(w), w)))
    parts = {
        "length": f"cast(length({value}) as double)",
        "digits": share("[0-9]"),
        "uppers": share("[A-Z]"),
        "lowers": share("[a-z]"),
        "others": share("[^A-Za-z0-9]"),
        "changes": share("(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[a-z])(?=[A-Z])"),
        "distinct": f"size(array_distinct(split({value}, ''))) / {n}",
        "vowels": share("[aeiouyAEIOUY]"),
        "coverage": f"1 - length(regexp_replace({value}, {_sql(covered)}, '')) / {n}",
        "hex": flag(value, "^[0-9a-fA-F]+$"),
        "numeric": flag(value, "^[0-9]+$"),
        "slashes": share("[/.\\\\-]"),
        "known": flag(value, f"^(?:{KNOWN_PREFIXES})|^-----BEGIN"),
        "named": flag(whole, f"(?i)^(?:{SECRET_WORDS})[\"']?\\s*[:=]"),
        "near_secret": flag(around, f"(?i)(?:{SECRET_WORDS})\\W{{0,8}}\\S*$"),
        "near_harmless": flag(left, f"(?i)(?:{HARMLESS_WORDS})\\S{{0,12}}\\W{{0,6}}$"),
        "after_harmless": flag(right, f"(?i)^\\W{{0,6}}\\S{{0,12}}(?:{HARMLESS_WORDS})"),
        "in_url": flag(around, r"(?i)(?:://|www\.)\S*$|^[./~]?/?(?:[A-Za-z0-9_.-]+/){2,}"),
        "test_path": flag(path, f"(?i){TEST_PATHS}"),
        "config_path": flag(path, f"(?i){CONFIG_PATHS}"),
    }
    return "named_struct(" + ", ".join(f"'{k}', cast({parts[k]} as double)" for k in FEATURES) + ")"


def with_candidates(docs: DataFrame, text_col: str, path_col: str | None = None, words: list[str] = DICTIONARY) -> DataFrame:
    """``docs`` with ``_quarry_found``: an array of (before, whole, value, f) of rows with candidates, else null.

    The text is cut at the candidates once; what lies between gives positions
    and the neighbouring words on both sides. ``value`` is what follows the name
    and its sign, ``before`` the text between the candidate and the one before;
    the last element has no ``whole`` and holds the rest of the text. Each step
    is a column of its own, so that no pattern is run twice for one candidate.
    """
    cut = _sql(CANDIDATE)
    value = f"regexp_replace(p.w, {_sql('(?is)^(?:' + SECRET_WORDS + ')[' + chr(34) + chr(39) + r']?\s{0,3}[:=]\s{0,3}[' + chr(34) + chr(39) + ']?')}, '')"
    path = f"coalesce(cast(`{path_col}` as string), '')" if path_col else "''"
    features = _features("p.value", "p.whole", "p.l", "p.r", path, words)
    out = docs.withColumn("_quarry_has", F.col(text_col).rlike(CANDIDATE))
    out = out.withColumn("_quarry_cut", F.when(F.col("_quarry_has"), F.expr(f"split(`{text_col}`, {cut}, -1)"))).withColumn("_quarry_hit", F.when(F.col("_quarry_has"), F.expr(f"regexp_extract_all(`{text_col}`, {cut}, 0)")))
    out = out.withColumn("_quarry_hit", F.expr(f"transform(_quarry_hit, (w, i) -> named_struct('w', w, 'b', element_at(_quarry_cut, i + 1), 'n', element_at(_quarry_cut, i + 2)))"))
    out = out.withColumn("_quarry_hit", F.expr(f"transform(_quarry_hit, p -> named_struct('before', p.b, 'whole', p.w, 'value', {value}, 'l', right(p.b, {NEAR}), 'r', left(p.n, {NEAR})))"))
    out = out.withColumn("_quarry_hit", F.expr(f"transform(_quarry_hit, p -> named_struct('before', p.before, 'whole', p.whole, 'value', p.value, 'f', {features}))"))
    rest = "array(named_struct('before', element_at(_quarry_cut, -1), 'whole', null, 'value', null, 'f', null))"
    return out.withColumn("_quarry_found", F.when(F.col("_quarry_has"), F.expr(f"concat(_quarry_hit, {rest})"))).drop("_quarry_has", "_quarry_cut", "_quarry_hit")


def labelled_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """Labelled findings to train on, made from hashes of their number: ``text, path, label``.

    Half are secrets of usual forms in usual places, half what scanners
    report falsely: checksums, ids, card numbers, paths, slugs, placeholders,
    names in code and long words.
    """
    h = lambda k: f"sha2(concat('{k}', id), 256)"
    b64 = lambda k: f"translate(base64(unhex({h(k)})), '=', '')"
    alnum = lambda k: f"translate({b64(k)}, '+/', 'xY')"
    caps = lambda k: f"translate(upper(substring({b64(k)}, 1, 16)), '+/0189', 'QRSTUV')"
    pick = lambda k, *xs: f"element_at(array({', '.join(_sql(x) for x in xs)}), 1 + cast(pmod(xxhash64('{k}', id), {len(xs)}) as int))"
    words = pick("w1", "red", "large", "river", "market", "simple", "window", "garden", "paper", "silver", "number")
    more = pick("w2", "theory", "houses", "station", "reading", "forest", "engine", "letters", "nation", "thing", "result")
    name = pick("n", "password", "secret", "token", "api_key", "access_key", "auth", "passwd", "client_secret", "API-KEY", "TOKEN", "Password")
    sign = pick("s", "=", " = ", ": ", '="', " = \"", "='", '": "')
    near = pick("m", "commit ", "sha256: ", "md5 ", "checksum=", "etag: ", "build ", "rev ", "uuid ", "trace ", "hash: ", "ref ", "at ", "in ", "see ", "")
    lead = pick("l", "stat ", "the value is ", "export ", "", "config ", "x ", "with ", "note ")
    line = pick("nl", "\n", "\n", "\r\n", "\\n")
    body = f"array_join(transform(sequence(1, 2 + cast(pmod(id, 24) as int)), i -> concat({line}, translate(concat(base64(unhex(sha2(concat('y', i, '-', id), 256))), base64(unhex(sha2(concat('z', i, '-', id), 256)))), '=', ''))), '')"
    secret = [
        f"concat({lead}, {name}, {sign}, substring({h('a')}, 1, 16 + cast(pmod(id, 25) as int)))",
        f"concat({lead}, {name}, {sign}, substring({alnum('b')}, 1, 12 + cast(pmod(id, 30) as int)))",
        f"concat({lead}, 'AKIA', {caps('c')})",
        f"concat({lead}, {pick('p', 'ghp_', 'sk-', 'xoxb-', 'glpat-', 'AIza', 'sk_live_')}, substring({alnum('d')}, 1, 32))",
        f"concat({lead}, {name}, {sign}, substring({b64('e')}, 1, 40))",
        f"concat({lead}, {name}, {sign}, upper(substring({words}, 1, 2)), {more}, {pick('x', '!7', '#42', '9$x', '_81', '2024!', '77@')}, substring({h('g')}, 1, 3))",
        f"concat({lead}, 'eyJ', substring({alnum('j')}, 1, 38))",
        f"concat({lead}, '-----BEGIN ', {pick('k', '', 'RSA ', 'EC ', 'OPENSSH ')}, 'PRIVATE KEY-----', if(pmod(id, 3) = 0, '', concat({body}, {line}, '-----END ', {pick('k', '', 'RSA ', 'EC ', 'OPENSSH ')}, 'PRIVATE KEY-----')))",
        f"concat({lead}, 'eyJ', substring({alnum('o')}, 1, 33), '.eyJ', substring({alnum('q')}, 1, 20 + cast(pmod(id, 20) as int)), '.', {alnum('r')})",
    ]
    harmless = [
        f"concat({near}, substring({h('A')}, 1, {pick('len', '40', '32', '64')}))",
        f"concat({near}, cast(1000000000000000 + pmod(xxhash64('card', id), 8000000000000000) as string))",
        f"concat({near}, substring({h('B')}, 1, 8), '-', substring({h('C')}, 1, 4), '-4', substring({h('D')}, 1, 3), '-a', substring({h('E')}, 1, 3), '-', substring({h('F')}, 1, 12))",
        f"concat({near}, '/usr/', {words}, '/lib64/', {more}, '/', {words}, '-', cast(pmod(id, 30) as string))",
        f"concat({near}, 'https://www.example.com/', {words}, '-', {more}, '-', cast(pmod(id, 3000) as string), '/page2')",
        f"concat({name}, {sign}, {pick('ph', 'changeme', 'your_password_here', 'example', 'placeholder', '<redacted>', 'getToken()', 'None', 'os.environ', '********', 'xxxxxxxx', 'process.env.TOKEN')})",
        f"concat({lead}, upper(concat({words}, {more}, {words}, {more})))",
        f"concat({lead}, {words}, '_', {more}, '_', {words}, '_', cast(pmod(id, 90) as string))",
        f"concat({lead}, cast(20200101000000 + pmod(xxhash64('ts', id), 90000000000) as string), '_', {words}, {more})",
    ]
    choose = lambda k, xs: f"element_at(array({', '.join(xs)}), 1 + cast(pmod(xxhash64('{k}', id), {len(xs)}) as int))"
    after = pick("after", "", "", "", " and more", " sha256", " checksum ok", "\\n", '"', " (example)")
    path = f"if(pmod(xxhash64('has', id), 4) > 0, '', if(pmod(xxhash64('odd', id), 10) < 8 = (id % 2 = 1), {pick('conf', 'app/.env', 'deploy/config.yml', 'id_rsa.pem', 'prod.tfvars')}, {pick('tests', 'tests/data.txt', 'docs/example.md', 'yarn.lock', 'vendor/list.txt')}))"
    return spark.range(n).selectExpr("id", f"concat(if(id % 2 = 1, {choose('pos', secret)}, {choose('neg', harmless)}), if(id % 2 = 1 AND pmod(id, 3) > 0, '', {after})) as text", f"{path} as path", "cast(id % 2 as double) as label")


def train_forest(findings: DataFrame, trees: int = TREES, depth: int = DEPTH) -> list[str]:
    """The forest of (text, label) findings: per tree the SQL that gives its vote on a struct ``f``.

    Findings are a bounded table (``FINDINGS`` made ones). Their features are
    computed once and written, for fitting reads them several times; fitting reads
    them in one sorted partition, so equal findings give an equal forest however
    they were dealt.
    """
    path = "path" if "path" in findings.columns else None
    rows = with_candidates(findings, "text", path).select("label", F.explode("_quarry_found").alias("c")).where("c.whole IS NOT NULL").select("label", "c.f.*")
    rows = materialize(rows, "finding-features")
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(rows.coalesce(1).sortWithinPartitions("label", *FEATURES)).select("x", "label")
    model = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=SEED).fit(data)
    discard(rows)
    return [tree_sql(t.toDebugString, FEATURES) for t in model.trees]


def tree_sql(described: str, features: tuple[str, ...] = FEATURES) -> str:
    """SQL of a decision tree on a struct ``f`` of features, from its indented description."""
    lines = [x.strip() for x in described.splitlines()[1:] if x.strip()]
    at = 0

    def node() -> str:
        nonlocal at
        line = lines[at]
        at += 1
        if m := re.match(r"Predict: (\S+)", line):
            return m[1] + "D"
        k, cut = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
        yes = node()
        at += 1  # the matching Else
        return f"if(f.{features[int(k)]} <= {float(cut)!r}D, {yes}, {node()})"

    return node()


_tree_sql = tree_sql


def forest_vote(trees: list[str], struct: str) -> str:
    """SQL of the share of trees that vote for a secret; ``struct`` is the features' SQL."""
    return "(" + " + ".join(re.sub(r"\bf\.", f"{struct}.", t) for t in trees) + f") / {float(len(trees))!r}D"


def find_secrets(docs: DataFrame, trees: list[str], id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, path_col: str | None = None, with_value: bool = False) -> DataFrame:
    """One row per candidate: ``id, start, length, named, secret_sha256, score, is_secret``.

    ``start`` is the 1-based code point of the value, ``length`` its own. The
    value is given as a digest, and as ``value`` only if asked for. ``path_col``
    names a column with the path of the file that the text is from, if there is
    one. Rows never leave their partition.

    Defined results: a null or empty text, or one without candidates, has no
    rows; equal candidates of a text, and repeated rows, each have their own. An
    empty table gives no rows. Other columns are ignored. A text of any length
    is searched whole, and a candidate may be of any length.
    """
    path = [F.col(path_col).alias("_path")] if path_col else []
    rows = with_candidates(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *path), "_text", "_path" if path_col else None).where("_quarry_found IS NOT NULL")
    rows = rows.select("_id", F.posexplode("_quarry_found").alias("_at", "c"), F.transform("_quarry_found", lambda x: F.length(x["before"]) + F.coalesce(F.length(x["whole"]), F.lit(0))).alias("_sizes")).where("c.whole IS NOT NULL")
    ahead = F.expr("aggregate(slice(_sizes, 1, _at + 1), 0, (n, x) -> n + x)")
    start = ahead - F.length("c.value") + 1
    value = [F.col("c.value").alias("value")] if with_value else []
    out = rows.select("_id", start.alias("start"), F.length("c.value").alias("length"), F.col("c.f.named").cast("boolean").alias("named"), *value, F.sha2(F.col("c.value").cast("binary"), 256).alias("secret_sha256"), F.expr(forest_vote(trees, "c.f")).alias("score"))
    return out.withColumn("is_secret", (F.col("score") >= threshold).cast("int")).withColumnRenamed("_id", id_col)


def redact_secrets(docs: DataFrame, trees: list[str], text_col: str = "text", threshold: float = THRESHOLD, mask: str = "[SECRET]", path_col: str | None = None, chars_col: str | None = None) -> DataFrame:
    """``docs`` with the values of found secrets replaced by ``mask`` at every candidate of the same value.

    The text is put together again from the pieces it was cut into, so the work
    is linear in its length. All rows and columns stay, whatever their names; null and
    empty texts stay as they are. ``chars_col`` names a column with the number of code
    points of the text, which is counted again where the text has changed.
    """
    path = [F.col(f"`{path_col}`").alias("_path")] if path_col else []
    found = with_candidates(docs.select(packed_row(docs), F.col(f"`{text_col}`").alias("_text"), *path), "_text", "_path" if path_col else None)
    gone = f"array_distinct(transform(filter(_quarry_found, c -> length(c.value) > 0 AND {forest_vote(trees, 'c.f')} >= {float(threshold)!r}D), c -> c.value))"
    found = found.withColumn("_quarry_gone", F.expr(gone))
    piece = f"concat(c.before, if(c.whole IS NULL, '', if(array_contains(_quarry_gone, c.value), concat(left(c.whole, length(c.whole) - length(c.value)), {_sql(mask)}), c.whole)))"
    masked = F.when(F.size("_quarry_gone") > 0, F.expr(f"array_join(transform(_quarry_found, c -> {piece}), '')"))
    found = found.withColumn("_masked", F.coalesce(masked, F.col("_text")))
    new = {text_col: F.col("_masked")}
    if chars_col in docs.columns:
        own = F.col(f"_row.c{docs.columns.index(chars_col)}")
        new[chars_col] = F.when(F.col("_masked").eqNullSafe(F.col("_text")), own).otherwise(F.length("_masked").cast(docs.schema[chars_col].dataType))
    return unpacked_row(found, docs.columns, **new)
