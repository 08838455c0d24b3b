"""Personal data: candidate spans from high-recall patterns, chosen by boosted trees; SQL expressions throughout.

The base patterns of the four kinds always count. Beyond them, generators propose further spans (written-out addresses,
phone numbers without a plus, cards in other groupings), overlapping ones included; trees score each by its format
and the words around it. They are trained on the driver on made-up examples, as no table labels spans, and run as CASE
expressions. A span's place comes from what lies between matches: the lengths of the gaps and matches before it.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm.boosting import BoostedTrees
from tramline.llm.pii_examples import examples
from tramline.llm.shared import read_table

KINDS = ["email", "ip", "card", "phone"]
_P = "[A-Za-z0-9._%+-]"
#: The base patterns; possessive and anchored at the start of a run, which changes no match but keeps very long runs
#: linear and off the stack.
BASE = {
    "email": rf"(?:\G|(?<!{_P})){_P}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap test that a text must pass to hold a match.
_MAY = {"email": "instr({t}, '@') > 0", "ip": "instr({t}, '.') > 0", "card": "true", "phone": "instr({t}, '+') > 0"}
_DIGITS = "regexp_replace({m}, '[^0-9]', '')"
_LUHN = "aggregate(sequence(1, char_length({d})), 0L, (s, i) -> s + IF(i % 2 = 1, int(substr(reverse({d}), i, 1)), (2 * int(substr(reverse({d}), i, 1))) div 10 + (2 * int(substr(reverse({d}), i, 1))) % 10)) % 10 = 0"
_VALID = {
    "email": "true",
    "ip": "forall(split({m}, '[.]'), q -> char_length(ltrim('0', q)) <= 3 AND coalesce(try_cast(ltrim('0', q) AS int), 0) <= 255)",
    "card": f"char_length({_DIGITS}) BETWEEN 16 AND 19 AND {_LUHN.format(d=_DIGITS)}",
    "phone": f"char_length({_DIGITS}) BETWEEN 8 AND 15",
}
_OPEN, _SHUT = r"[\[({<] ?", r" ?[\])}>]"
#: (kind, pattern): what else may be one.
GENERATORS = [
    ("email", rf"(?i)(?<!{_P}){_P}{{1,64}}+ ?{_OPEN}(?:at|@){_SHUT} ?[a-z0-9-]{{1,63}}(?: ?(?:\.|{_OPEN}(?:dot|\.){_SHUT}) ?[a-z0-9-]{{1,63}}){{1,4}}"),
    ("email", rf"(?i)(?<!{_P}){_P}{{1,64}}+ at [a-z0-9-]{{1,63}}(?: dot [a-z0-9-]{{1,63}}){{1,4}}"),
    ("ip", rf"(?i)(?<![0-9.])[0-9]{{1,3}}(?: ?(?:{_OPEN}(?:\.|dot){_SHUT}|(?<= )dot(?= )) ?[0-9]{{1,3}}){{3}}(?![0-9])"),
    ("card", r"(?<![0-9A-Za-z])[0-9]{4}([./_]|  )[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9A-Za-z])"),
    ("card", r"(?<![0-9A-Za-z])(?<![0-9][\x20-])3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}(?![0-9A-Za-z])(?![\x20-][0-9])"),
    ("phone", r"(?<![0-9A-Za-z+.(_-])(?<![0-9] )(?:00[1-9][0-9]{0,2}[ .-])?(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z_-])(?![ .][0-9])"),
]
_GENERATOR_MAY = [
    r"{t} RLIKE '(?i)[\\[({{<] ?(?:at|@) ?[\\])}}>]'", "{t} RLIKE '(?i) dot '", r"{t} RLIKE '(?i)[0-9] ?(?:dot|[\\[({{<] ?(?:dot|\\.) ?[\\])}}>])'",
    r"{t} RLIKE '[0-9]{{4}}(?:[./_]|  )[0-9]{{4}}'", "{t} RLIKE '3[47][0-9]{{2}}[ -]?[0-9]{{6}}'", r"{t} RLIKE '[0-9][ .-][0-9]{{3,4}}(?![0-9])'",
]
_SPANS = "array<struct<s:int,e:int,m:string>>"
#: Characters of context on either side, and the cues looked for in the one before.
CONTEXT = 32
_CUES = {
    "cue_phone": r"\b(?:phone|tel|call|mobile|cell|fax|telefon|tél|teléfono|móvil|whatsapp|number is)\b",
    "cue_card": r"\b(?:card|visa|amex|mastercard|credit|karte|carte|tarjeta|paid with)\b",
    "cue_mail": r"\b(?:e-?mail|mail|contact|write|reach|kontakt|contacto)\b",
    "cue_host": r"\b(?:ip|host|server|address|from)\b",
    "cue_other": r"\b(?:order|ref|serial|ticket|total|isbn|invoice|version|id|item|part|section|chapter|release|room|tracking|account|between|scores?)\b",
}
FEATURES = ["generator", "n_chars", "n_digits", "n_groups", "luhn", "octets", "parens", "zeros", "top_domain", "common_before", *_CUES]
EXAMPLES, PRECISION = 4_000, 0.98


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", "''") + "'"


def _spans(text: str, pattern: str, valid: str, may: str) -> str:
    """SQL for the valid matches in a text, with start and end in code points; ``valid`` is about {m}."""
    matches, gaps = f"regexp_extract_all({text}, {_quoted(pattern)}, 0)", f"split({text}, {_quoted(pattern)}, -1)"
    start = "a.p + char_length(x.g)"
    step = f"named_struct('p', {start} + char_length(x.m), 'o', IF({valid.format(m='x.m')}, concat(a.o, array(named_struct('s', {start}, 'e', {start} + char_length(x.m), 'm', x.m))), a.o))"
    pairs = f"zip_with(h.ms, slice(h.gs, 1, size(h.ms)), (m, g) -> named_struct('m', m, 'g', g))"
    begin = f"named_struct('p', 0, 'o', cast(array() AS {_SPANS}))"
    # the outer transform binds matches and gaps once; a text without a match is not split
    one = f"array(named_struct('ms', {matches}))"
    both = f"transform(filter({one}, k -> size(k.ms) > 0), k -> named_struct('ms', k.ms, 'gs', {gaps}))"
    return f"IF({may.format(t=text)}, coalesce(get(transform({both}, h -> aggregate({pairs}, {begin}, (a, x) -> {step}, a -> a.o)), 0), cast(array() AS {_SPANS})), cast(array() AS {_SPANS}))"


def _features(text: str, generator: str) -> str:
    """SQL for a struct of features of span ``c`` in a text."""
    before = f"lower(substr({text}, greatest(1, c.s - {CONTEXT - 1}), least(c.s, {CONTEXT})))"
    digits = _DIGITS.format(m="c.m")
    words = "the|was|we|it|in|and|of|this|they|what|then|some|more|end|had|made|look|meet|stay|stop"
    values = {
        "generator": generator,
        "n_chars": "char_length(c.m)",
        "n_digits": f"char_length({digits})",
        "n_groups": "size(regexp_extract_all(c.m, '[0-9]+', 0))",
        "luhn": f"int({digits} <> '' AND {_LUHN.format(d=digits)})",
        "octets": "int(forall(regexp_extract_all(c.m, '[0-9]+', 0), q -> char_length(q) <= 3 AND int(q) <= 255))",
        "parens": r"int(c.m RLIKE r'[(\[{]')",
        "zeros": "int(c.m LIKE '00%')",
        "top_domain": r"int(c.m RLIKE r'(?i)\b(?:com|org|net|edu|gov|info|io|eu|de|fr|es|uk|it|nl|ch)$')",
        "common_before": rf"int(c.m RLIKE r'(?i)^(?:{words}) ')",
        **{name: f"int({before} RLIKE {_quoted(cue)})" for name, cue in _CUES.items()},
    }
    return "named_struct(" + ", ".join(f"'{k}', double({v})" for k, v in values.items()) + ")"


def _candidates(text: str) -> str:
    """SQL for all proposed spans: array of (k, s, e, f) with the kind's index and the features."""
    parts = []
    for i, ((kind, pattern), may) in enumerate(zip(GENERATORS, _GENERATOR_MAY, strict=True)):
        spans = _spans(text, pattern, "true", may)
        parts.append(f"transform({spans}, c -> named_struct('k', {KINDS.index(kind)}, 's', c.s, 'e', c.e, 'f', {_features(text, str(i))}))")
    return f"concat({', '.join(parts)})"


@lru_cache(maxsize=4)
def _trained(rows: str) -> tuple[BoostedTrees, dict[int, float]]:
    """Trees and each kind's threshold: the least score at which half of the examples, kept from training, are precise."""
    data = json.loads(rows)
    values, labels, kinds = (np.array([r[i] for r in data], float) for i in range(3))
    values = values.reshape(len(data), len(FEATURES))
    test = np.arange(len(data)) % 2 == 1
    model = BoostedTrees.fit(values[~test], labels[~test], FEATURES)
    scores, cuts = model.score(values[test]), {}
    for k in range(len(KINDS)):
        own = kinds[test] == k
        order = np.argsort(-scores[own], kind="stable")
        right, s = labels[test][own][order], scores[own][order]
        good = np.flatnonzero(np.cumsum(right) / np.arange(1, len(right) + 1) >= PRECISION)
        cuts[k] = max(0.5, float(s[good[-1]])) if len(good) else 1.1
    return model, cuts


def train(spark: SparkSession) -> tuple[BoostedTrees, dict[int, float]]:
    """Features of the made-up examples come from the same expressions as those of texts; a bounded table."""
    made = json.dumps(examples(EXAMPLES))
    table = spark.range(1, numPartitions=1).select(F.explode(F.from_json(F.lit(made), "array<struct<text:string,start:int,end:int,label:int>>")).alias("x")).select("x.*")
    found = table.select("start", "end", "label", F.explode(F.expr(_candidates("text"))).alias("c"))
    label = F.expr("int(label = 1 AND c.s >= start AND c.e <= end)")
    rows = [(list(r.f), r.label, r.k) for r in found.select("c.f", label.alias("label"), "c.k").collect()]
    return _trained(json.dumps(sorted(rows)))


def personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: tuple[BoostedTrees, dict[int, float]] | None = None) -> DataFrame:
    """Per row: id, ``base`` and ``spans`` (array of struct ``kind``, ``s``, ``e``: code points, end exclusive) in the
    order of ``KINDS``, then of start, and the number of base spans of each kind (``n_email`` and so on, long).

    ``spans`` holds the base spans and those that the model adds, which overlap neither a base span nor one added
    before them (by start). A null or empty text has none; repeated rows and null ids pass through, row for row; an
    empty table gives an empty table; other columns are not read. Map-only.
    """
    trees, cuts = model or train(docs.sparkSession)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"))
    kinds = [f"transform({_spans('t', BASE[k], _VALID[k], _MAY[k])}, c -> named_struct('k', {i}, 's', c.s, 'e', c.e))" for i, k in enumerate(KINDS)]
    spans = texts.select("id", F.expr(f"concat({', '.join(kinds)})").alias("base"), F.expr(_candidates("t")).alias("proposed"))
    cut = "element_at(map(" + ", ".join(f"{k}, {v!r}D" for k, v in cuts.items()) + "), c.k)"
    chosen = f"filter(proposed, c -> {trees.sql('c.f.')} >= {cut} AND NOT exists(base, b -> b.s < c.e AND c.s < b.e))"
    ordered = f"array_sort(transform({chosen}, c -> named_struct('s', c.s, 'e', c.e, 'k', c.k)))"
    apart = f"aggregate({ordered}, named_struct('p', 0, 'o', cast(array() AS array<struct<k:int,s:int,e:int>>)), (a, c) -> IF(c.s >= a.p, named_struct('p', c.e, 'o', concat(a.o, array(named_struct('k', c.k, 's', c.s, 'e', c.e)))), a), a -> a.o)"
    spans = spans.select("id", "base", F.expr(f"IF(size(proposed) = 0, base, array_sort(concat(base, {apart})))").alias("spans"))
    names = F.array(*map(F.lit, KINDS))

    def named(column: str) -> Column:
        return F.transform(column, lambda c: F.struct(F.get(names, c["k"]).alias("kind"), c["s"].alias("s"), c["e"].alias("e")))

    counts = [F.expr(f"cast(size(filter(base, c -> c.k = {i})) AS long) AS n_{k}") for i, k in enumerate(KINDS)]
    return spans.select(F.col("id").alias(id_col), named("base").alias("base"), named("spans").alias("spans"), *counts)


def redact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", mark: str = "[{}]") -> DataFrame:
    """id and ``text_col`` with each span of ``personal_data`` replaced by its kind in brackets; rows are kept apart
    by id and text, so repeated ids with different texts are fine. Spans of two kinds that overlap become one mark."""
    both = docs.select(F.col(f"`{id_col}`").alias("__id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__text"))
    found = personal_data(both.select(F.struct("__id", "__text").alias("row"), F.col("__text").alias("text")), id_col="row")
    step = f"named_struct('p', greatest(a.p, c.e), 'o', IF(c.s < a.p, a.o, concat(a.o, substr(row.__text, a.p + 1, c.s - a.p), '{mark.split('{}')[0]}', c.kind, '{mark.split('{}')[1]}')))"
    text = f"aggregate(array_sort(transform(spans, c -> named_struct('s', c.s, 'e', c.e, 'kind', c.kind))), named_struct('p', 0, 'o', ''), (a, c) -> {step}, a -> concat(a.o, substr(row.__text, a.p + 1)))"
    return found.select(F.col("row.__id").alias(id_col), F.expr(text).alias(text_col))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(read_table(spark, sf_dir, "documents").select("doc_id", "text"))

    def joined(column: str) -> Column:
        return F.array_join(F.transform(column, lambda c: F.concat_ws(":", c["kind"], c["s"], c["e"])), ",")

    return found.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
