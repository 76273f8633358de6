"""Personal data by candidate gradient boosting, in DataFrame and SQL functions only.

1. Base rules find e-mail addresses, IPv4 addresses, payment cards and phone numbers by pattern and
   check (parts, Luhn, digit counts). Base spans always stay.
2. High-recall generators propose further spans of each kind in looser forms; they may overlap.
3. Every candidate is described by format features (digits, groups, separators, start) and context
   features (neighbour characters, cue words before it). All are small categories. What only tells
   a looser form from a base pattern (the sign used, a plus, which separator) is left out, and so is
   what decides the proof of point 4.
4. A candidate that touches no base span is judged by checks of its own (``PROOFS``): proved (Luhn
   without the separators; a spelled-out address with a top-level domain; digit count and a cue word
   or a dialling form; four octets and a cue word), contradicted (a check fails) or open. Boosted
   depth-2 trees are fitted to tell base spans and proved candidates from the others. The fit reads
   counts per feature combination, summed over all documents by Spark: a bounded table
   (``MAX_CELLS``, the most frequent combinations), whatever the corpus size.
5. For each kind a threshold is calibrated on the documents left out of the fit (crc32 of the id,
   remainder 2 of 4): the lowest score at which the proved among the proved and contradicted
   candidates reach ``PRECISION``. Base spans show that a score occurs, but do not count in that
   share, and open candidates are no errors. A contradicted candidate counts as the errors that
   pass the check beside it (``CHANCE``). Proved candidates at or above the threshold are added, and
   open ones if most candidates like them are proved (score 0 or more); contradicted ones never.
   Without such a score none is.

Patterns start at the head of a run (look-behind, or the end of the previous match) and repeat
possessively, so that they find just what the plain patterns find, in linear time and without
recursion on long runs.

Defined results: null texts count as empty (no spans); offsets are code points, the end exclusive;
repeated rows are judged each; columns beside doc_id and text are not read; null ids are kept (and
count for the fit); an empty table gives no rows.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexivec.llm.common import save, text_or_empty

KINDS = ("email", "ip", "card", "phone")
LOCAL = "[A-Za-z0-9._%+-]"
#: The base patterns, in possessive form.
BASE = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
AT, DOT = r"[(\[{](?i:at)[)\]}]", r"[(\[{](?i:dot)[)\]}]"
LABEL = "[A-Za-z0-9-]"
#: Looser forms: spelled-out signs, other separators, numbers without a plus sign.
LOOSE = {
    "email": rf"(?<!{LOCAL}){LOCAL}++(?:\x20?{DOT}\x20?{LOCAL}++){{0,8}}+(?:\x20?(?:@|{AT})\x20?{LABEL}++(?:(?:\.|\x20\.\x20|\x20?{DOT}\x20?|\x20(?i:dot)\x20){LABEL}++)*+"
    rf"|\x20(?i:at)\x20{LABEL}++(?:\x20(?i:dot)\x20{LABEL}++)++)",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:(?:[.,:]|\[\.\]|\x20?[(\[](?i:dot)[)\]]\x20?)[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}(?:(\x20?[\p{P}\p{S}]\x20?|[\x20\xA0])[0-9]{2,6}(?:\1[0-9]{2,6}){1,3}|(?:[\x20./_-]?[0-9]{2,6}){2,4})(?![0-9])",
    "phone": r"(?<![0-9+])(?:\+|00)?\(?[0-9][0-9()\x20./-]{6,20}[0-9](?![0-9])",
}
#: Words before a span that name its kind.
CUES = {
    "email": "e-?mail|courriel|correo|contact|write",
    "ip": "(^|[^a-z])ip([^a-z]|$)|host|server|address|adresse",
    "card": "card|visa|credit|karte|carte|tarjeta",
    "phone": "tel|phone|call|fax|mobil|appel|anruf|llam",
}
FEATURES = ("digits", "parts", "seps", "head", "before", "after", "cue")
CONTEXT = 24
#: Array elements that are added up at a time (see ``_located``).
BLOCK = 256
MAX_CELLS = 50_000
ROUNDS, RATE, SHRINK = 30, 0.4, 1.0
PRECISION = 0.98


# --- spans -----------------------------------------------------------------------------------------


def _located(pieces: str, found: str) -> str:
    """SQL: struct(s, e, m, l, r) for each match, from the texts between matches and the matches:
    code-point offsets, the match, the end of the text before, the first character after. Running
    sums go by blocks, so that many matches cost time in proportion."""
    pair = f"named_struct('a', {pieces}[b * {BLOCK} + i], 'm', m, 'z', {pieces}[b * {BLOCK} + i + 1])"
    blocks = f"transform(sequence(0, (size({found}) - 1) div {BLOCK}), b -> transform(slice({found}, b * {BLOCK} + 1, {BLOCK}), (m, i) -> {pair}))"
    width = "aggregate(y, 0L, (t, x) -> t + char_length(x.a) + char_length(x.m))"
    starts = f"aggregate(transform({blocks}, y -> {width}), named_struct('at', 0L, 'all', cast(array() as array<bigint>)), (a, n) -> named_struct('at', a.at + n, 'all', concat(a.all, array(a.at))), a -> a.all)"
    one = (
        "aggregate(y['0'], named_struct('at', y['1'], 'all', cast(array() as array<struct<s:bigint,e:bigint,m:string,l:string,r:string>>)), (a, x) -> named_struct("
        "'at', a.at + char_length(x.a) + char_length(x.m), 'all', concat(a.all, array(named_struct("
        "'s', a.at + char_length(x.a), 'e', a.at + char_length(x.a) + char_length(x.m), 'm', x.m, "
        f"'l', right(x.a, {CONTEXT}), 'r', left(x.z, 1))))), a -> a.all)"
    )
    return f"if(size({found}) = 0, cast(array() as array<struct<s:bigint,e:bigint,m:string,l:string,r:string>>), flatten(transform(arrays_zip({blocks}, {starts}), y -> {one})))"


DIGITS = "regexp_replace(x.m, '[^0-9]', '')"
LUHN = (
    "aggregate(sequence(1, length(d)), 0, (a, i) -> a + int(substr(reverse(d), i, 1)) * if(i % 2 = 0, 2, 1)"
    " - if(i % 2 = 0 and int(substr(reverse(d), i, 1)) > 4, 9, 0)) % 10 = 0"
)
#: SQL checks of base matches.
CHECKS = {
    "email": "true",
    "ip": "forall(split(x.m, '[.]'), p -> coalesce(try_cast(right(concat('000', ltrim('0', p)), greatest(3, length(ltrim('0', p)))) as bigint), 256) <= 255)",
    "card": f"exists(array({DIGITS}), d -> length(d) between 12 and 19 and {LUHN})",
    "phone": f"length({DIGITS}) between 9 and 15",
}


def _lit(pattern: str) -> str:
    """A pattern as a SQL string."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: A spelled-out address as it would be written plainly, in lower case.
PLAIN = (
    f"lower(replace(regexp_replace(regexp_replace(x.m, {_lit(DOT + '|(?<=' + chr(92) + 'x20)(?i:dot)(?=' + chr(92) + 'x20)')}, '.'),"
    f" {_lit(AT + '|(?<=' + chr(92) + 'x20)(?i:at)(?=' + chr(92) + 'x20)')}, '@'), ' ', ''))"
)
DIALLED = r"(?:^|[^a-z])(?:tel(?:[^l]|$)|tele|t\xe9l|phone|call|cell|fax|mobil|m\xf3vil|appel|anruf|ruf|llam|whatsapp|sms)"
OTHER = r"(?:^|[^a-z])(?:order|invoice|isbn|issn|ref|reference|sku|serial|item|lot|batch|version|ticket|article|artikel|bestell[a-z]*|rechnung[a-z]*|facture|commande|pedido|factura)[^a-z0-9]*(?:(?:id|no|nr|num|number)[^a-z0-9]*)?$"
OCTETS = "split(x.m, '[^0-9]+')"
#: SQL: does a looser match x hold by itself (true), is it contradicted (false), or open (null)?
PROOFS = {
    "email": f"""case when {PLAIN} not rlike '^[a-z0-9][a-z0-9._%+-]*+@[a-z0-9][a-z0-9.-]*[.][a-z]{{2,24}}$' or {PLAIN} like '%..%' then false
        when x.m rlike {_lit('@|' + AT)} or {PLAIN} rlike '[.](com|org|net|edu|gov|mil|info|biz|io|dev|app|eu|de|fr|es|uk)$' or lower(x.l) rlike '{CUES["email"]}' then true end""",
    "ip": f"""case when exists({OCTETS}, p -> coalesce(try_cast(p as int), 256) > 255 or (p like '0_%')) or size(array_distinct(regexp_extract_all(x.m, '[^0-9]+', 0))) > 1 then false
        when x.m like '%[%' or x.m like '%(%' or lower(x.l) rlike '{CUES["ip"]}' then true end""",
    "card": f"case when not {CHECKS['card']} then false when lower(x.l) rlike {_lit(OTHER)} then null else true end",
    "phone": f"""case when length({DIGITS}) < 9 and lower(x.l) rlike {_lit(DIALLED)} then null when length({DIGITS}) not between 9 and 15 then false
        when lower(x.l) rlike {_lit(DIALLED)} then true when lower(x.l) rlike {_lit(OTHER)} or {CHECKS['card']} or x.m rlike '^[0-9]{{4}}[-./][0-9]{{1,2}}[-./][0-9]{{1,2}}([^0-9]|$)|^[0-9]{{1,2}}[-./][0-9]{{1,2}}[-./][0-9]{{4}}([^0-9]|$)' then false
        when x.m rlike '^(00[1-9]|[(]0?[1-9][0-9]{{1,4}}[)])' then true end""",
}
#: Other matches are no candidates.
LIKELY = {"card": f"length({DIGITS}) between 12 and 19"}
#: Contradicted candidates for one that passes its kind's check by chance: Luhn holds for one number in ten.
CHANCE = {"email": 1.0, "ip": 1.0, "card": 9.0, "phone": 1.0}


def _features(kind: str) -> str:
    """SQL: the categories of a located match x, as small integers; 0 where a category would only
    tell base patterns from looser forms, or decide the proof."""
    number = "regexp_replace(x.m, '^([+]|00)', '')"
    digits = f"least(length({DIGITS}), 20)" if kind in ("email", "card") else "0"
    parts = f"least(size(split({PLAIN if kind == 'email' else number}, '[^0-9A-Za-z]+')), 8)" if kind != "ip" else "0"
    seps = f"least(size(array_distinct(regexp_extract_all({number}, '[^0-9]+', 0))), 2)" if kind in ("card", "phone") else "0"
    head = "case when x.m rlike '^[3-6]' then 3 when x.m rlike '^2' then 2 else 1 end" if kind == "card" else "0"
    side = lambda c: (
        f"case when {c} = '' then 0 when {c} rlike '[\\\\s]' then 1 when {c} rlike '\\\\p{{L}}' then 2 when {c} rlike '[0-9]' then 3 when {c} rlike '[:=#<(]' then 4 else 5 end"
    )
    return f"""named_struct(
        'digits', {digits},
        'parts', {parts},
        'seps', {seps},
        'head', {head},
        'before', {side("right(x.l, 1)")},
        'after', {side("coalesce(x.r, '')")},
        'cue', if(lower(x.l) rlike '{CUES[kind]}', 1, 0))"""


def spans_and_candidates(docs: DataFrame) -> DataFrame:
    """(row, doc_id, base, loose) for every row of ``docs`` (doc_id, text): base spans (s, k, e),
    and candidates (s, k, e, f: the features, p: the proof); a candidate may come twice."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text_or_empty().alias("t"))
    signs = F.col("t").contains("@") | F.col("t").rlike(AT + r"|\x20(?i:dot)\x20")
    has = {"email": F.col("t").contains("@"), "phone": F.col("t").contains("+")}
    lists = []
    for form, patterns in (("b", BASE), ("c", LOOSE)):
        for kind, pattern in patterns.items():
            skip = ~(signs if (form, kind) == ("c", "email") else has.get(kind, F.lit(True)) if form == "b" else F.lit(True))
            lists.append(F.when(skip, F.array(F.lit(""))).otherwise(F.split("t", pattern, -1)).alias(f"p_{form}_{kind}"))
            lists.append(F.when(skip, F.array().cast("array<string>")).otherwise(F.regexp_extract_all("t", F.lit(pattern), F.lit(0))).alias(f"m_{form}_{kind}"))
    cut = rows.select("row", "doc_id", *lists)
    located = cut.select("row", "doc_id", *[F.expr(_located(f"p_{f}_{k}", f"m_{f}_{k}")).alias(f"{f}_{k}") for f in "bc" for k in KINDS])
    base = ", ".join(f"transform(filter(b_{k}, x -> {CHECKS[k]}), x -> named_struct('s', x.s, 'k', {n}, 'e', x.e))" for n, k in enumerate(KINDS))
    loose = ", ".join(
        f"transform(filter(concat(b_{k}, c_{k}), x -> {LIKELY.get(k, 'true')}), x -> named_struct('s', x.s, 'k', {n}, 'e', x.e, 'f', {_features(k)}, 'p', {PROOFS[k]}))" for n, k in enumerate(KINDS)
    )
    return located.select("row", "doc_id", F.expr(f"array_sort(concat({base}))").alias("base"), F.expr(f"concat({loose})").alias("loose"))


def labelled(found: DataFrame) -> DataFrame:
    """The distinct candidates of ``spans_and_candidates`` (row, doc_id, s, e, k, f, p, label): label
    1 equals a base span, 0 touches none, null touches one. Running extremes over a document's
    spans by start find what touches, in time n log n. ``p`` is judged where the label is 0."""
    loose = found.select("row", "doc_id", F.explode("loose").alias("c")).select("row", "doc_id", "c.*", F.lit(0).alias("base"))
    base = found.select("row", "doc_id", F.explode("base").alias("c")).select("row", "doc_id", "c.*", F.lit(None).cast(loose.schema["f"].dataType).alias("f"), F.lit(None).cast("boolean").alias("p"), F.lit(1).alias("base"))
    each = loose.unionByName(base).groupBy("row", "doc_id", "s", "e", "k").agg(F.min("f").alias("f"), F.max("p").alias("p"), F.max("base").alias("base"))
    sofar = Window.partitionBy("row").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    is_base = F.col("base") == 1
    touches = F.coalesce(F.max(F.when(is_base, F.col("e"))).over(sofar.orderBy("s")) > F.col("s"), F.lit(False)) | F.coalesce(
        F.min(F.when(is_base, F.col("s"))).over(sofar.orderBy(F.desc("s"))) < F.col("e"), F.lit(False)
    )
    return each.select("row", "doc_id", "s", "e", "k", "f", "p", F.when(is_base, 1).when(~touches, 0).alias("label"))


# --- boosting on counted feature combinations ------------------------------------------------------


class Cell:
    """One feature combination: kind, categories, and its weights (positives, rows; base spans that
    are in neither)."""

    def __init__(self, kind: int, values: tuple, positives: float, rows: float, base: float = 0.0):
        self.values = (kind, *values)
        self.positives, self.rows, self.base, self.score = positives, rows, base, 0.0


def _gain(gradient: float, weight: float) -> float:
    return gradient * gradient / (weight + SHRINK)


def _best_test(cells: list[Cell], gradients: list[tuple[float, float]]) -> tuple | None:
    """The test ``feature == value`` that splits best by second-order gain."""
    all_g, all_h = sum(g for g, _ in gradients), sum(h for _, h in gradients)
    best, found = 1e-6, None
    for f in range(len(FEATURES) + 1):
        sums: dict[int, list[float]] = {}
        for c, (g, h) in zip(cells, gradients, strict=True):
            s = sums.setdefault(c.values[f], [0.0, 0.0])
            s[0] += g
            s[1] += h
        if len(sums) < 2:
            continue
        for value in sorted(sums):
            g, h = sums[value]
            gain = _gain(g, h) + _gain(all_g - g, all_h - h) - _gain(all_g, all_h)
            if gain > best:
                best, found = gain, (f, value)
    return found


def _leaf(gradients: list[tuple[float, float]]) -> float:
    return RATE * sum(g for g, _ in gradients) / (sum(h for _, h in gradients) + SHRINK)


def boost(cells: list[Cell], rounds: int = ROUNDS) -> list[tuple]:
    """Trees (test, (test, leaf, leaf), (test, leaf, leaf)); a side without a test is a leaf pair of
    equal values. Logistic loss, Newton leaves; cells weigh as many rows as they stand for."""
    trees = []
    for _ in range(rounds):
        gradients = []
        for c in cells:
            p = 1 / (1 + math.exp(-c.score))
            gradients.append((c.positives - c.rows * p, c.rows * p * (1 - p)))
        root = _best_test(cells, gradients)
        if root is None:
            break
        sides = []
        for wanted in (True, False):
            part = [(c, g) for c, g in zip(cells, gradients, strict=True) if (c.values[root[0]] == root[1]) is wanted]
            test = _best_test([c for c, _ in part], [g for _, g in part])
            if test is None:
                leaf = _leaf([g for _, g in part])
                sides.append((root, leaf, leaf))
            else:
                yes = [g for c, g in part if c.values[test[0]] == test[1]]
                no = [g for c, g in part if c.values[test[0]] != test[1]]
                sides.append((test, _leaf(yes), _leaf(no)))
        trees.append((root, *sides))
        for c in cells:
            c.score += tree_value(trees[-1], c.values)
    return trees


def tree_value(tree: tuple, values: tuple) -> float:
    root, yes, no = tree
    test, one, other = yes if values[root[0]] == root[1] else no
    return one if values[test[0]] == test[1] else other


def tree_sum(trees: list[tuple], values: tuple) -> float:
    """The trees' sum as SQL adds it up: ``sum`` would carry the rounding errors along."""
    return reduce(add, (tree_value(t, values) for t in trees), 0.0)


def score_sql(trees: list[tuple]) -> str:
    """The trees' sum as one SQL expression over a candidate's columns."""
    name = lambda f: "k" if f == 0 else f"f.{FEATURES[f - 1]}"
    side = lambda s: f"if({name(s[0][0])} = {s[0][1]}, {s[1]!r}D, {s[2]!r}D)"
    return " + ".join(f"if({name(r[0])} = {r[1]}, {side(y)}, {side(n)})" for r, y, n in trees) or "0D"


def thresholds(cells: list[Cell], trees: list[tuple], precision: float) -> dict[int, float]:
    """Per kind, the lowest score at and above which the positives' share reaches ``precision``, if
    positives or base spans have such a score."""
    out = {}
    for kind in range(len(KINDS)):
        own = sorted(((tree_sum(trees, c.values), c.positives, c.rows, c.base) for c in cells if c.values[0] == kind), reverse=True)
        good = rows = base = 0.0
        for i, (score, p, n, b) in enumerate(own):
            good, rows, base = good + p, rows + n, base + b
            if (i + 1 == len(own) or own[i + 1][0] < score) and good >= precision * rows and good + base > 0:
                out[kind] = score
    return out


def fit(candidates: DataFrame, max_cells: int = MAX_CELLS, precision: float = PRECISION) -> tuple[list[tuple], dict[int, float]]:
    """Trees and thresholds from ``labelled`` candidates: one aggregate over all documents."""
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    one = candidates.where("label is not null").withColumn("held_out", held_out)
    sums = {"b": "label = 1", "p": "label = 0 and p", "c": "label = 0 and not p"}
    counted = one.groupBy("held_out", "k", *[F.col(f"f.{f}").alias(f) for f in FEATURES]).agg(
        *[F.expr(f"count_if({test})").alias(name) for name, test in sums.items()], F.count(F.lit(1)).alias("n")
    )
    table = counted.orderBy(F.desc("n"), "k", *FEATURES).limit(max_cells).collect()
    values = lambda r: tuple(r[f] for f in FEATURES)
    trees = boost([Cell(r.k, values(r), float(r.b + r.p), float(r.n)) for r in table if not r.held_out])
    kept_out = [Cell(r.k, values(r), float(r.p), r.p + r.c / CHANCE[KINDS[r.k]], float(r.b)) for r in table if r.held_out]
    return trees, thresholds(kept_out, trees, precision)


# --- results ---------------------------------------------------------------------------------------


def select_spans(found: DataFrame, candidates: DataFrame, trees: list[tuple], limits: dict[int, float]) -> DataFrame:
    """(doc_id, base, spans): base spans and the added ones, sorted by start, kind, end."""
    # Scores equal to a threshold are in; the SQL sums in the same order as Python.
    enough = " or ".join(f"(k = {k} and score >= {s!r}D)" for k, s in sorted(limits.items())) or "false"
    chosen = candidates.where("label = 0 and coalesce(p, true)").withColumn("score", F.expr(score_sql(trees))).where(enough).where("p or score >= 0")
    added = chosen.groupBy("row").agg(F.collect_list(F.struct("s", "k", "e")).alias("added"))
    every = F.expr("array_sort(concat(base, coalesce(added, slice(base, 1, 0))))")
    return found.select("row", "doc_id", "base").join(added, "row", "left").select("doc_id", "base", every.alias("spans"))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans) for every row; each text is scanned once."""
    found = save(spans_and_candidates(docs), "pii-spans")
    candidates = save(labelled(found), "pii-candidates")
    return select_spans(found, candidates, *fit(candidates))


def spans_text(spans: Column | str) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x.k], x.s, x.e)), ",")


def redact(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind in brackets; of overlapping spans the first."""
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(a, x):
        before = F.substr(text, (a.at + 1).cast("int"), (x.s - a.at).cast("int"))
        return F.when(x.s >= a.at, F.struct(x.e.alias("at"), F.concat(a.out, before, names[x.k]).alias("out"))).otherwise(a)

    return F.aggregate(spans, start, step, lambda a: F.concat(a.out, F.substr(text, (a.at + 1).cast("int"))))
