"""Personal data: base patterns, and further spans proposed by generators and judged by boosted trees.

Everything is DataFrame and SQL expressions over a text: it is cut at the matches
of a pattern, and what lies between gives positions and neighbouring words. Rows
never leave their partition.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import discard, materialize, packed_row, parts_for, unpacked_row
from quarry.llm.secrets import _sql, tree_sql

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
#: The base patterns, written so that the JVM's regular expressions need time linear in
#: the text: a run is entered at its beginning (or where the last match ended) and not given back.
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_MARK = r"(?:\s?[\[({<]\s?(?i:at|@)\s?[\])}>]\s?|\s@\s?|@\s?)"
_AT = rf"(?:{_MARK}|\s(?i:at)\s)"
_DOT = r"(?:\s?[\[({<]\s?(?i:dot|\.)\s?[\])}>]\s?|\s(?i:dot)\s|\s\.\s?|\.)"
_HOST = rf"[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++"
#: Generators: whatever may be meant as an address, a card or a number, in any usual or disguised form.
PROPOSE = {
    # words before and after a plain "at" are none where what follows it begins an address of a plainer mark
    "email": rf"(?<!{_LOCAL}){_LOCAL}++(?:{_MARK}{_HOST}|\s(?i:at)\s{_HOST}(?!{_LOCAL}*+{_MARK}{_HOST}))",
    "ip": rf"(?<![0-9A-Za-z.:])(?:[0-9]{{1,3}}{_DOT}){{3}}[0-9]{{1,3}}(?![0-9A-Za-z])"
    r"|(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"
    r"|(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])(?:[0-9]{4}[\x20._/-]?){3}[0-9]{4}(?:[\x20.-]?[0-9]{1,3})?(?![0-9])"
    r"|(?<![0-9])3[47][0-9]{2}[\x20.-]?[0-9]{6}[\x20.-]?[0-9]{5}(?![0-9])|(?<![0-9])[0-9]{13,19}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+.-])(?:(?:\+|00)[0-9]{1,3}[\x20.-]?|[0-9]{1,2}[\x20.-])?(?:\([0-9]{2,4}\)[\x20.-]?|[0-9]{2,4}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9A-Za-z])"
    r"|\+[0-9]{8,15}(?![0-9])",
}
#: What a text must hold before a pattern is tried on it: a part that every match has, so a gate loses none.
_GATE = {"email": _AT, "ip": "[0-9:]", "card": "[0-9]", "phone": "[0-9]"}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
#: Words beside personal data of each kind, and beside numbers that are none.
GOOD_WORDS = {"email": "mail|contact|write|reach|send", "ip": r"\bip\b|host|server|address|login|client|connect", "card": "card|visa|master|amex|credit|debit|payment|charge", "phone": "phone|tel|call|mobile|cell|fax|dial|text me|reach|sms"}
BAD_WORDS = r"version|release|build|section|chapter|figure|isbn|issn|order|invoice|serial|part|sku|tracking|\bref|doi|case|commit|\bid\b|score|page|room|table|ticket|timestamp|\bv$"
FEATURES = ("is_email", "is_ip", "is_card", "is_phone", "digits", "length", "groups", "luhn", "issuer", "distinct", "plus", "parens", "spaces", "hyphens", "dots", "disguised", "word_at", "word_dot", "at_sign", "tld", "octets", "colons", "dateish", "left_symbol", "right_symbol", "near_good", "near_bad")
#: Usual last parts of hosts, all in small or all in large letters; a sentence that begins with "It" has none.
_TLD = "com|org|net|edu|gov|io|info|de|fr|es|uk|eu|ch|at|nl|it"
#: Neighbouring words are those within so many code points.
NEAR = 48
TREES, DEPTH, STEP, SEED = 24, 4, 0.3, 7
#: Made findings, and different findings that are fitted on in one partition.
FINDINGS, FIT_ROWS = 8000, 200_000
#: Calibration: of what a kind's threshold lets pass, this share is right on findings that were
#: not fitted on; and no threshold is lower than the other figure.
PRECISION, LEAST_SCORE = 0.98, 0.5
MASK = "█"


@dataclass(frozen=True)
class Model:
    """Boosted trees as the SQL of a score on a struct ``f``, and the threshold of each kind."""

    score: str
    thresholds: dict[str, float]


def _valid(kind: str, m: str) -> str:
    """SQL: whether a base match stays."""
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    return {
        "email": "true",
        "ip": f"{m} rlike {_sql(f'^{_OCTET}(?:[.]{_OCTET}){{3}}$')}",
        "card": f"if(length({digits}) BETWEEN 16 AND 19, luhn_check({digits}), false)",
        "phone": f"length({digits}) BETWEEN 8 AND 15",
    }[kind]


def _running(sizes: str) -> str:
    """SQL: for each element of an array of numbers the sum of those before.

    Blocks of about the root of the length are summed first, so appending to an
    array never copies more than a block.
    """
    block = f"greatest(1, cast(ceil(sqrt(size({sizes}))) as int))"
    ks = f"sequence(0, (size({sizes}) - 1) div {block})"
    push = "(r, x) -> named_struct('t', r.t + x, 'a', array_append(r.a, r.t))"
    none = "cast(array() as array<int>)"
    part = lambda k: f"slice({sizes}, cast({k} * {block} + 1 as int), {block})"
    sums = f"transform({ks}, k -> aggregate({part('k')}, 0, (a, x) -> a + x))"
    offsets = f"aggregate({sums}, named_struct('t', 0, 'a', {none}), {push}).a"
    return f"flatten(transform({offsets}, (o, k) -> aggregate({part('k')}, named_struct('t', o, 'a', {none}), {push}).a))"


_PIECE = "array<struct<before: string, hit: string, after: string, start: int>>"


def _cut(df: DataFrame, name: str, source: str, pattern: str, gate: str) -> DataFrame:
    """``df`` with ``name``: the pieces (before, hit, after, start) of a text cut at a pattern's matches.

    The last piece has no hit; without matches there are no pieces. ``start`` counts
    code points from 0. Every step is a column of its own and refers to others
    outside of lambdas alone, so that no pattern runs twice.
    """
    h, p, z, s = f"{name}_h", f"{name}_p", f"{name}_z", f"{name}_s"
    df = df.withColumn(h, F.expr(f"if({gate}, regexp_extract_all({source}, {_sql(pattern)}, 0), cast(array() as array<string>))"))
    df = df.withColumn(p, F.expr(f"if(size({h}) > 0, split({source}, {_sql(pattern)}, -1), array({source}))"))
    df = df.withColumn(z, F.expr(f"arrays_zip({p}, {h}, slice({p}, 2, size({h})))"))
    df = df.withColumn(z, F.expr(f"transform({z}, x -> named_struct('before', x.{p}, 'hit', x.{h}, 'after', x.`2`))"))
    df = df.withColumn(s, F.expr(f"if(size({h}) > 0, transform({z}, x -> length(x.before) + coalesce(length(x.hit), 0)), array(0))"))
    df = df.withColumn(s, F.expr(_running(s)))
    df = df.withColumn(name, F.expr(f"if(size({h}) > 0, transform(arrays_zip({z}, {s}), x -> named_struct('before', x.{z}.before, 'hit', x.{z}.hit, 'after', x.{z}.after, 'start', x.{s} + length(x.{z}.before))), cast(array() as {_PIECE}))"))
    return df.drop(h, p, z, s)


def _spans(kind: str, pieces: str, keep: str) -> str:
    """SQL: the spans of those pieces whose hit ``x.hit`` is to be kept."""
    kept = f"filter({pieces}, x -> x.hit IS NOT NULL AND {keep})"
    return f"transform({kept}, x -> named_struct('kind', '{kind}', 'start', x.start, 'end', x.start + length(x.hit), 'base', true, 'score', 1D))"


def _with_base(df: DataFrame) -> DataFrame:
    """``df`` (with ``_t``, a text) with ``_b_<kind>``, the base spans of each kind, and ``_c_<kind>``, the pieces."""
    for kind in KINDS:
        gate = "contains(_t, '@')" if kind == "email" else "contains(_t, '+')" if kind == "phone" else "_t rlike '[0-9]'"
        df = _cut(df, f"_c_{kind}", "_t", BASE[kind], gate)
        df = df.withColumn(f"_b_{kind}", F.expr(_spans(kind, f"_c_{kind}", _valid(kind, "x.hit"))))
    return df


def _with_proposals(df: DataFrame, source: str) -> DataFrame:
    """``df`` with ``_props``: (kind, start, end, f) of all that the generators propose in a text."""
    for kind in KINDS:
        df = _cut(df, f"_p_{kind}", source, PROPOSE[kind], f"{source} rlike {_sql(_GATE[kind])}")
    found = [f"transform(filter(_p_{k}, x -> x.hit IS NOT NULL), x -> named_struct('kind', '{k}', 'start', x.start, 'hit', x.hit, 'l', right(x.before, {NEAR}), 'r', left(x.after, {NEAR}), 'd', regexp_replace(x.hit, '[^0-9]', '')))" for k in KINDS]
    df = df.withColumn("_props", F.expr(f"concat({', '.join(found)})")).drop(*[f"_p_{k}" for k in KINDS])
    return df.withColumn("_props", F.expr(f"transform(_props, p -> named_struct('kind', p.kind, 'start', p.start, 'end', p.start + length(p.hit), 'f', {_features()}))"))


def _features() -> str:
    """SQL of the feature struct of a proposal ``p``."""
    flag = lambda text, rx: f"cast({text} rlike {_sql(rx)} as double)"
    count = lambda rx: f"regexp_count(p.hit, {_sql(rx)})"
    good = " OR ".join(f"(p.kind = '{k}' AND concat(p.l, ' ', left(p.r, 16)) rlike {_sql('(?i)' + w)})" for k, w in GOOD_WORDS.items())
    parts = {
        **{f"is_{k}": f"p.kind = '{k}'" for k in KINDS},
        "digits": "length(p.d)",
        "length": "length(p.hit)",
        "groups": count("[0-9]+"),
        "luhn": "if(length(p.d) BETWEEN 13 AND 19, luhn_check(p.d), false)",
        "issuer": flag("p.d", "^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5|4[4-9]))"),
        "distinct": "size(array_distinct(split(p.d, '')))",
        "plus": flag("p.hit", r"^(?:\+|00)"),
        "parens": flag("p.hit", r"\([0-9]"),
        "spaces": count(r"\s"),
        "hyphens": count("-"),
        "dots": count(r"\."),
        "disguised": flag("p.hit", r"(?i)[\[({<]\s?(?:at|@|dot|\.)"),
        "word_at": flag("p.hit", r"(?i)\sat\s"),
        "word_dot": flag("p.hit", r"(?i)\sdot\s"),
        "at_sign": flag("p.hit", "@"),
        "tld": flag("p.hit", rf"[.\s\])}}>]\s?(?:{_TLD}|{_TLD.upper()})$"),
        "octets": f"NOT p.hit rlike {_sql('(?<![0-9])(?:25[6-9]|2[6-9][0-9]|[3-9][0-9]{2}|[0-9]{4,})(?![0-9])')}",
        "colons": count(":"),
        "dateish": flag("p.hit", r"^(?:19|20)[0-9]{2}(?![0-9])|[\x20.-](?:19|20)[0-9]{2}$"),
        "left_symbol": flag("p.l", "[#$€£=/_*:.-]$"),
        "right_symbol": flag("p.r", "^[/_%*=:-]"),
        "near_good": good,
        "near_bad": flag("right(p.l, 24)", "(?i)" + BAD_WORDS),
    }
    return "named_struct(" + ", ".join(f"'{k}', cast({parts[k]} as double)" for k in FEATURES) + ")"


def made_findings(spark: SparkSession, n: int = FINDINGS, first: int = 0) -> DataFrame:
    """Findings made from hashes of their number: ``text, kind, label``.

    Half are addresses, cards and numbers in plain and disguised forms, half what
    looks like them: versions, order and serial numbers, dates, timestamps, scores,
    sentences with "at". Nothing of ``documents`` is used.
    """
    pick = lambda k, *xs: f"element_at(array({', '.join(_sql(x) for x in xs)}), 1 + cast(pmod(xxhash64('{k}', id), {len(xs)}) as int))"
    num = lambda k, lo, hi: f"cast({lo} + pmod(xxhash64('{k}', id), {hi - lo + 1}) as string)"
    pad = lambda k, width: f"lpad(cast(pmod(xxhash64('{k}', id), {10**width}) as string), {width}, '0')"
    name = pick("n1", "anna", "j.smith", "maria_k", "info", "thomas", "li.wei", "sales", "r2d2", "the.office", "otto-b")
    site = pick("n2", "mail", "example", "post", "web-mail", "company", "uni", "firma", "acme")
    tld = pick("n3", "com", "org", "net", "de", "edu", "io", "fr", "es")
    word = pick("w", "house", "river", "meeting", "station", "market", "garden", "end", "school")
    then = pick("w2", "Then", "The", "And", "Next", "We", "It")
    sep = pick("sep", " ", "-", "", ".")
    # 15 digits of an issuer and the digit that makes the sum right; the wrong one is off by 1 to 9
    body = f"concat({pick('iss', '4', '51', '37', '6011', '2221', '55')}, {pad('card', 15)})"
    d15 = f"substring({body}, 1, 15)"
    check = f"element_at(filter(sequence(0, 9), c -> luhn_check(concat({d15}, cast(c as string)))), 1)"
    right, wrong = f"concat({d15}, cast({check} as string))", f"concat({d15}, cast(pmod({check} + 1 + pmod(xxhash64('off', id), 9), 10) as string))"
    fours = lambda x: f"concat_ws({sep}, substring({x}, 1, 4), substring({x}, 5, 4), substring({x}, 9, 4), substring({x}, 13, 4))"
    octet = lambda k: num(k, 0, 255)
    hexes = "concat_ws(':', " + ", ".join(f"lower(hex(pmod(xxhash64('x{i}', id), 65536)))" for i in range(8)) + ")"
    kinds = ["email", "email", "ip", "ip", "ip", "card", "card", "phone", "phone", "phone", "phone"]  # of the eleven below
    real = [
        f"concat({name}, '@', {site}, '.', {tld})",
        f"concat({name}, {pick('at', ' [at] ', '(at)', ' at ', ' @ ', ' AT ', ' {at} ', ' <at> ')}, {site}, {pick('dot', ' [dot] ', '(dot)', ' dot ', ' DOT ', '.', ' . ')}, {tld})",
        f"concat_ws('.', {octet('a')}, {octet('b')}, {octet('c')}, {octet('d')})",
        f"concat_ws({pick('idot', '[.]', ' dot ', '(.)', '[dot]')}, {octet('a')}, {octet('b')}, {octet('c')}, {octet('d')})",
        hexes,
        fours(right),
        fours(right),
        f"concat('+', {num('cc', 1, 99)}, ' (', {pad('area', 3)}, ') ', {pad('ex', 3)}, '-', {pad('line', 4)})",
        f"concat({pick('cc2', '', '+1 ', '1-', '0049 ', '+44-')}, '(', {pad('area', 3)}, ') ', {pad('ex', 3)}, '-', {pad('line', 4)})",
        f"concat({pad('area', 3)}, '-', {pad('ex', 3)}, '-', {pad('line', 4)})",
        f"concat('+', {num('cc', 1, 99)}, {pad('long', 9)})",
    ]
    unlike = [
        f"concat({pick('vb', 'look at ', 'meet at ', 'arrive at ', 'stay at ')}, {word}, '.', {then})",
        f"concat({word}, ' at ', {word}, ' dot ', {then})",
        f"concat_ws('.', {num('va', 0, 20)}, {num('vb', 0, 40)}, {num('vc', 0, 99)}, {num('vd', 0, 99)})",
        f"concat_ws('.', {num('va', 256, 999)}, {octet('b')}, {octet('c')}, {num('vd', 0, 999)})",
        f"concat_ws(':', {pad('hh', 2)}, {pad('mm', 2)}, {pad('ss', 2)}, {pad('ms', 2)}, {pad('a1', 2)}, {pad('a2', 2)}, {pad('a3', 2)}, {pad('a4', 2)})",
        fours(wrong),
        wrong,
        f"concat({num('year', 1950, 2029)}, '-', {pad('o1', 4)}, '-', {pad('o2', 4)})",
        f"concat({pad('o1', 2)}, '-', {pad('o2', 4)}, '-', {pad('o3', 4)})",
        f"concat({num('s1', 10, 9999)}, ' ', {num('s2', 100, 9999)}, ' ', {num('s3', 100, 9999)})",
        f"concat('20', {pad('ts', 12)})",
    ]
    tie = lambda i: f"pmod(xxhash64('c{i}', id), 10)"
    good = pick("good", "contact ", "write to ", "mail: ", "call me at ", "phone: ", "tel. ", "card ", "pay with visa ", "server ", "host ", "ip ", "my number is ")
    plain = pick("plain", "", "and ", "the ", "was ", "of them ", "see ", "with ", ", ", "(", "here is ")
    bad = pick("bad", "version ", "v", "order ", "serial no. ", "section ", "invoice #", "part ", "isbn ", "score ", "id=", "build ", "table ")
    after = pick("after", "", "", ".", ", and", " for more", ")", " again", " is")
    choose = lambda k, xs: f"element_at(array({', '.join(xs)}), 1 + cast(pmod(xxhash64('{k}', id), {len(xs)}) as int))"
    lead = f"if(id % 2 = 1, if({tie(1)} < 5, {plain}, {good}), if({tie(2)} < 5, {plain}, {bad}))"
    return spark.range(first, first + n).selectExpr("id", f"concat({lead}, if(id % 2 = 1, {choose('pos', real)}, {choose('neg', unlike)}), {after}) AS text", f"{choose('pos', [_sql(k) for k in kinds])} AS kind", "cast(id % 2 AS double) AS label")


def made_proposals(made: DataFrame) -> DataFrame:
    """``id, label, kind, f`` of all proposals in findings; those of another kind than what was made are none."""
    rows = _with_proposals(made.withColumn("_t", F.col("text")), "_t")
    rows = rows.select("id", "label", F.col("kind").alias("_k"), F.explode_outer("_props").alias("p")).where("p IS NOT NULL")
    return rows.selectExpr("id", "if(p.kind = _k, label, 0D) AS label", "p.kind", "p.f")


def labelled_proposals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``label`` and features of proposals in all documents, labelled by the base rules.

    A proposal inside a base span of its kind is personal data; one that is a whole
    base match which the rules drop (a card whose check digit is wrong, an address
    with a part over 255) is none; all others have no label and are left out.
    """
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("_t"), F.xxhash64(F.col(id_col).cast("string"), F.length(text_col)).alias("_k"))
    rows = _with_proposals(_with_base(rows), "_t")
    inside = " OR ".join(f"(p.kind = '{k}' AND exists(_b_{k}, b -> b.start <= p.start AND p.end <= b.end))" for k in KINDS)
    failed = " OR ".join(f"(p.kind = '{k}' AND exists(_c_{k}, x -> x.start = p.start AND x.start + length(x.hit) = p.end AND NOT {_valid(k, 'x.hit')}))" for k in KINDS)
    labelled = f"filter(transform(_props, p -> named_struct('label', if({inside}, 1D, if({failed}, 0D, null)), 'f', p.f)), q -> q.label IS NOT NULL)"
    # outer, for the filter that Spark infers from a plain one would be moved below all steps and repeat them
    return rows.select("_k", F.explode_outer(F.expr(labelled)).alias("q")).where("q IS NOT NULL").select(F.col("_k").alias("id"), "q.label", "q.f.*")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = PRECISION) -> Model:
    """Boosted trees of made findings and of proposals labelled in the documents; thresholds by calibration.

    Proposals of all documents count, those of equal label and features once, which is
    settled by a shuffle. Every fifth finding is kept from fitting; a kind's threshold is
    the least at which, among those, the share of personal data is ``precision`` for it
    and for all above. Up to ``FIT_ROWS`` different findings are fitted on in one sorted
    partition, and equal tables give equal models; more are dealt over several.
    """
    made = made_proposals(made_findings(docs.sparkSession)).select("id", "label", "f.*")
    # equal proposals of copied texts are one
    rows = materialize(made.unionByName(labelled_proposals(docs, id_col, text_col)).groupBy("label", *FEATURES).agg(F.min("id").alias("id")), "pii-findings")
    split = F.pmod(F.xxhash64("id", "label", "length", "digits"), F.lit(5)) == 0
    fit = rows.where(~split)
    parts = parts_for(fit.count(), FIT_ROWS)
    fit = (fit.coalesce(1) if parts == 1 else fit.repartition(parts, "label", *FEATURES)).sortWithinPartitions("label", *FEATURES)
    x = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(fit).select("x", "label")
    model = GBTClassifier(featuresCol="x", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=SEED).fit(x)
    margin = " + ".join(f"{float(w)!r}D * {tree_sql(t.toDebugString, FEATURES)}" for t, w in zip(model.trees, model.treeWeights, strict=True))
    score = f"1D / (1D + exp(-2D * ({margin})))"
    kind = "CASE " + " ".join(f"WHEN is_{k} > 0 THEN '{k}'" for k in KINDS) + " END"
    held = rows.where(split).selectExpr(f"{kind} AS kind", "label", f"named_struct({', '.join(f'{chr(39)}{c}{chr(39)}, {c}' for c in FEATURES)}) AS f").selectExpr("kind", "label", f"floor(100 * ({score})) AS cut")
    counts = {(r["kind"], r["cut"]): (r["n"], r["good"]) for r in held.groupBy("kind", "cut").agg(F.count("*").alias("n"), F.sum("label").alias("good")).collect()}
    discard(rows)
    return Model(score, {k: _least_threshold(k, counts, precision) for k in KINDS})


def _least_threshold(kind: str, counts: dict, precision: float) -> float:
    """The least hundredth, ``LEAST_SCORE`` or more, from which on all higher ones keep the precision; over 1 where none does."""
    n = good = 0
    least = 1.01
    for cut in range(100, -1, -1):
        more = counts.get((kind, cut), (0, 0))
        n, good = n + more[0], good + more[1]
        if n and good < precision * n:
            break
        if n:
            least = cut / 100
    return max(least, LEAST_SCORE)


def _found(docs: DataFrame, model: Model, text_col: str) -> DataFrame:
    """``docs`` with ``_spans``: base spans and those of accepted proposals, by kind, then start.

    Generators see the text with base spans masked, so that what they propose never
    holds a part of one.
    """
    rows = _with_base(docs.withColumn("_t", F.coalesce(F.col(text_col), F.lit("")))).withColumn("_w", F.col("_t"))
    for kind in KINDS:
        rows = _cut(rows, "_m", "_w", BASE[kind], f"size(_b_{kind}) > 0")
        hidden = f"if({_valid(kind, 'x.hit')}, repeat('{MASK}', length(x.hit)), x.hit)"
        rows = rows.withColumn("_w", F.expr(f"if(size(_m) > 0, array_join(transform(_m, x -> concat(x.before, if(x.hit IS NULL, '', {hidden}))), ''), _w)")).drop("_m")
    rows = _with_proposals(rows, "_w")
    at_least = "CASE " + " ".join(f"WHEN p.kind = '{k}' THEN {t!r}D" for k, t in model.thresholds.items()) + " END"
    score = re.sub(r"\bf\.", "p.f.", model.score)
    rows = rows.withColumn("_props", F.expr(f"transform(_props, p -> named_struct('kind', p.kind, 'start', p.start, 'end', p.end, 'base', false, 'score', {score}))"))
    more = f"filter(_props, p -> p.score >= {at_least})"
    rows = rows.withColumn("_more", F.expr(more))
    one = [f"array_sort(concat(_b_{k}, filter(_more, p -> p.kind = '{k}')))" for k in KINDS]
    rows = rows.withColumn("_spans", F.expr(f"concat({', '.join(one)})"))
    return rows.drop("_t", "_w", "_props", "_more", *[f"_{a}_{k}" for a in "bc" for k in KINDS])


def find_pii(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id, spans``, an array of (kind, start, end, base, score).

    ``start`` and ``end`` (exclusive) count code points from 0; spans are ordered by
    kind as in ``KINDS``, then start. Base spans have ``base`` true and score 1; the
    others are proposals outside of base spans whose score reaches their kind's
    threshold, and those of different kinds may overlap.

    Defined results: a null or empty text has no spans; ids of any type, null ones
    too, and repeated rows have a row each; an empty table gives no rows; other
    columns are ignored. A text of any length is searched whole, in time linear in it
    but for a root of the number of its matches.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return _found(rows, model, "_text").select(F.col("_id").alias(id_col), F.col("_spans").alias("spans"))


def redact_pii(docs: DataFrame, model: Model, text_col: str = "text", mask: str = "[{}]") -> DataFrame:
    """``docs`` with every span replaced by ``mask`` with its kind in upper case; overlapping spans are one, of the first's kind.

    All rows and columns stay, whatever their names; null and empty texts stay as they are.
    """
    packed = docs.select(packed_row(docs), F.col(f"`{text_col}`").alias("_text"))
    spans = "array_sort(_spans, (a, b) -> if(a.start < b.start, -1, if(a.start > b.start, 1, b.end - a.end)))"
    label = "CASE " + " ".join(f"WHEN s.kind = '{k}' THEN {_sql(mask.format(k.upper()))}" for k in KINDS) + " END"
    step = f"if(s.start >= r.at, named_struct('at', s.end, 'out', concat(r.out, substring(_text, r.at + 1, s.start - r.at), {label})), named_struct('at', greatest(r.at, s.end), 'out', r.out))"
    out = _found(packed, model, "_text").withColumn("_done", F.expr(f"if(size(_spans) > 0, aggregate({spans}, named_struct('at', 0, 'out', ''), (r, s) -> {step}, r -> concat(r.out, substring(_text, r.at + 1))), _text)"))
    return unpacked_row(out, docs.columns, **{text_col: F.col("_done")})


def span_digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document the number of base spans of each kind, the digest of base spans, and all spans as text."""
    lines = lambda spans: f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"
    base = "filter(spans, s -> s.base)"
    counts = [F.expr(f"cast(size(filter(spans, s -> s.base AND s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS]
    return found.select(id_col, *counts, F.sha2(F.expr(lines(base)).cast("binary"), 256).alias("base_sha256"), F.expr(lines("spans")).alias("spans"))
