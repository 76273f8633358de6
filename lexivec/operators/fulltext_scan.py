"""Full-text search as two passes over the texts, for queries that fit the broadcast budget.

The first pass counts: rows, tokens, and the rows of every token that a query names or that begins with
one of its prefixes. The second scores: all queries go to every task, each batch of rows is matched with
them by its token numbers, and a task lets go only of rows that can be among a query's best ``k`` of those
it has seen. No postings are shuffled or stored, so what is moved does not grow with the matches.

Words of queries are bounded by the queries, what begins with a prefix is not: beyond ``MOST_TERMS`` only the
most frequent go to the tasks. A row that has others is judged by the least and the most that they can add, and
the few rows that are let go get their exact weights by a join with the counts.

Rows, scores and ties are those of ``operators.fulltext`` and ``operators.boolean`` over the stored index,
which answer larger query sets. Tokens are cut by ``functions.text.tokens`` in either case.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.config import RetrievalConfig
from lexivec.session import store_once
from lexivec.sources.tables import TableSpec
from lexivec.sources.text_index import doc_tokens, text_columns

MARGIN = 2e-6  # scores are compared after rounding to six digits
ROWS, CELLS = 256, 1 << 20  # rows, and (row, query) scores, held at a time in a task
#: What a token of a clause, a counted term and a (term, query) entry take in a task.
TOKEN_BYTES, ENTRY_BYTES = 256, 32
MOST_TERMS = 1 << 16


class Lists:
    """Number -> list of rows of ``values``; built from (number, *values) rows."""

    def __init__(self, n: int, rows, width: int = 1):
        rows = np.array(sorted(rows), np.int64).reshape(-1, width + 1)
        self.sizes = np.bincount(rows[:, 0], minlength=n)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])[:-1]
        self.values = rows[:, 1:].T.copy()

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, ...]:
        """(place in ``numbers``, *values) of every list entry."""
        sizes = self.sizes[numbers]
        place = np.repeat(np.arange(len(numbers)), sizes)
        at = np.arange(len(place)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + self.starts[numbers][place]
        return place, *self.values[:, at]


class Plan:
    """Clauses ``(q, op, toks, exact, prefix, phrase)``, numbered, with the counted terms."""

    def __init__(self, clauses: list[tuple], terms: list[str], idf: np.ndarray, n_queries: int, most_entries: int):
        self.terms, self.idf, self.n_queries = terms, idf, n_queries
        number = {t: n for n, t in enumerate(terms)}
        prefixes = {c[4]: None for c in clauses if c[4] is not None}
        self.prefixes = {p: n for n, p in enumerate(prefixes)}
        under = {p: [] for p in prefixes}
        lengths = sorted({len(p) for p in prefixes})
        for n, t in enumerate(terms):
            for size in lengths:
                if t[:size] in under and len(t) >= size:
                    under[t[:size]].append(n)
        self.n_required = np.zeros(n_queries, np.int64)
        words, starts, static, bodies, long_uses = [], [], set(), {}, []
        self.entries = sum(len(under[c[4]]) if c[4] is not None else len(c[3]) for c in clauses)
        if self.entries > most_entries:
            return
        for q, op, toks, exact, prefix, phrase in clauses:
            self.n_required[q] += op == "+"
            body = (tuple(toks) if phrase else (), tuple(exact), prefix)
            if not all(t in number for t in exact):
                continue  # a token that no row has
            if phrase or len(exact) + (prefix is not None) > 1:
                long_uses.append((bodies.setdefault(body, len(bodies)), q, op))
                continue
            own = [number[exact[0]]] if prefix is None else under[prefix]
            if op != "-":
                static.update((t, q) for t in own)
            if op:
                (words if prefix is None else starts).append((number[exact[0]] if prefix is None else self.prefixes[prefix], q, op == "+"))
        n_terms, n_prefixes = len(terms), len(self.prefixes)
        self.static = Lists(n_terms, static)
        self.prefix_of = Lists(n_terms, ((t, self.prefixes[p]) for p, ts in under.items() for t in ts))
        self.bodies = [([number[t] for t in toks], self.prefixes.get(prefix)) for toks, _, prefix in bodies]
        self.n_exact = np.array([len(exact) for _, exact, _ in bodies], np.int64)
        self.body_of = Lists(n_terms, ((number[t], n) for (_, exact, _), n in bodies.items() for t in exact))
        parts = [[*(number[t] for t in exact), *under.get(prefix, [])] for _, exact, prefix in bodies]
        more = {(n, q, t) for n, q, op in long_uses if op != "-" for t in parts[n] if (t, q) not in static}
        self.more = Lists(len(bodies), more, 2)
        signed = lambda n, uses: Lists(n, uses, 2)
        self.marks = (signed(n_terms, words), signed(n_prefixes, starts), signed(len(bodies), [(n, q, op == "+") for n, q, op in long_uses if op]))
        # for tokens that are not among the terms
        self.lengths = {size: [p for p in self.prefixes if len(p) == size] for size in lengths}
        self.under_prefix = Lists(n_prefixes, {(self.prefixes[c[4]], c[0]) for c in clauses if c[4] is not None and not c[3] and c[1] != "-"})
        self.uses = Lists(len(bodies), {(n, q) for n, q, op in long_uses if op != "-"})
        self.rows = max(1, min(ROWS, CELLS // max(1, n_queries, len(bodies), n_prefixes)))

    def beginnings(self, every: pa.Array, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(token, prefix) of the distinct tokens that begin with a prefix and are not among the terms."""
        tokens, prefixes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for size, those in self.lengths.items() if self.left_out else ():
            at = pc.index_in(pc.utf8_slice_codeunits(every, 0, size), value_set=pa.array(those, pa.string()))
            at = pc.fill_null(at, -1).to_numpy(zero_copy_only=False)
            found = np.nonzero((at >= 0) & (number < 0))[0]
            tokens.append(found)
            prefixes.append(np.array([self.prefixes[p] for p in those], np.int64)[at[found]])
        return np.concatenate(tokens), np.concatenate(prefixes)

    def scores(self, row: np.ndarray, number: np.ndarray, n: int, length: np.ndarray, code: np.ndarray, others: Lists | None) -> tuple:
        """Scores (rows x queries) of the terms, -inf where a query does not admit a row, and ``(cell, token, part)``
        of the other tokens under the query's prefixes: ``part`` times their idf adds to the cell. ``row``,
        ``number``: of every token in order, -1 for others and between columns; ``code``: the token's in the
        batch, whose prefixes are ``others``; ``length``: the part of the weight that the row gives."""
        n_terms, n_queries = len(self.terms), self.n_queries
        known = number >= 0
        pair, tf = np.unique(row[known] * n_terms + number[known], return_counts=True)
        r, t = np.divmod(pair, max(1, n_terms))
        w = self.idf[t] * tf * self.gain / (tf + length[r])
        place, q = self.static.of(t)
        total = np.bincount(r[place] * n_queries + q, weights=w[place], minlength=n * n_queries)
        met = [(r, t)]
        place, p = self.prefix_of.of(t)
        starts = np.zeros((n, max(1, len(self.prefixes))), bool)
        starts[r[place], p] = True
        far = np.zeros((4, 0), np.int64)  # row, token, prefix, count of what is not among the terms
        if others is not None:
            kept = others.sizes[code] > 0
            own, count = np.unique(row[kept] * len(others.sizes) + code[kept], return_counts=True)
            fr, fu = np.divmod(own, len(others.sizes))
            place, p = others.of(fu)
            far = np.stack([fr[place], fu[place], p, count[place]])
            starts[far[0], p] = True
        met.append(np.nonzero(starts[:, : len(self.prefixes)]))
        body = self.long(row, number, n, r, t, starts)
        met.append(body)
        place, q, t = self.more.of(body[1])
        if len(place):
            triple = np.unique((body[0][place] * n_queries + q) * n_terms + t)
            cell, t = np.divmod(triple, n_terms)
            key = cell // n_queries * n_terms + t
            at = np.minimum(np.searchsorted(pair, key), len(pair) - 1)
            there = pair[at] == key  # not every extension of a prefix is in the row
            total += np.bincount(cell[there], weights=w[at[there]], minlength=n * n_queries)
        required, excluded = np.zeros(n * n_queries, np.int64), np.zeros(n * n_queries, bool)
        for lists, (r, x) in zip(self.marks, met, strict=True):
            place, q, plus = lists.of(x)
            cell, plus = r[place] * n_queries + q, plus.astype(bool)
            required += np.bincount(cell[plus], minlength=n * n_queries)
            excluded[cell[~plus]] = True
        total, required, excluded = (x.reshape(n, n_queries) for x in (total, required, excluded))
        cell, token, count = self.added(far, body, n_queries)
        part = count * self.gain / (count + length[cell // n_queries])
        some = total > 0
        some.reshape(-1)[cell] = True
        # every matched clause that is not excluded adds a positive weight
        return np.where(some & (required == self.n_required) & ~excluded, total, -np.inf), cell, token, part

    def added(self, far: np.ndarray, body: tuple, n_queries: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cell, token, count), each once, of the other tokens that clauses of a query add."""
        place, q = self.under_prefix.of(far[2])
        found = [np.stack([far[0][place] * n_queries + q, far[1][place], far[3][place]])]
        if far.shape[1]:
            for r, j in zip(*body, strict=True):
                if self.bodies[j][1] is not None:
                    own = far[:, (far[0] == r) & (far[2] == self.bodies[j][1])]
                    for q in self.uses.of(np.array([j]))[1]:
                        found.append(np.stack([own[0] * n_queries + q, own[1], own[3]]))
        return tuple(np.unique(np.concatenate(found, axis=1), axis=1)) if far.shape[1] else tuple(np.zeros((3, 0), np.int64))

    def long(self, row, number, n, r, t, starts) -> tuple[np.ndarray, np.ndarray]:
        """(row, body) of the clauses of several tokens that match."""
        if not self.bodies:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place, body = self.body_of.of(t)
        size = len(self.bodies)
        hit = np.bincount(r[place] * size + body, minlength=n * size).reshape(n, size) == self.n_exact
        for j in np.nonzero(hit.any(axis=0))[0]:
            toks, prefix = self.bodies[j]
            if prefix is not None:
                hit[:, j] &= starts[:, prefix]
            if toks:
                end = len(number) - len(toks) + 1
                at = np.nonzero(number[:end] == toks[0])[0]
                for k, tok in enumerate(toks[1:], 1):
                    at = at[number[at + k] == tok]
                once = np.zeros(n, bool)
                once[row[at]] = True
                hit[:, j] &= once
        return np.nonzero(hit)


def token_arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, pa.Array]:
    """(tokens of each row, all tokens) of the column ``toks``."""
    toks = batch.column(batch.schema.get_field_index("toks"))
    return pc.list_value_length(toks).to_numpy(zero_copy_only=False).astype(np.int64), toks.flatten()


def counted_terms(texts: DataFrame, words: list[str], prefixes: list[str]) -> DataFrame:
    """``(term, n, size)``: the rows of every wanted token; without a term, all rows and their tokens."""
    spark = texts.sparkSession
    by_length: dict[int, list[str]] = {}
    for p in prefixes:
        by_length.setdefault(len(p), []).append(p)
    shared = spark.sparkContext.broadcast((words, by_length))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, starts = shared.value
        words = pa.array(words, pa.string())
        for batch in batches:
            sizes, flat = token_arrays(batch)
            coded = flat.dictionary_encode()
            every, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            wanted = pc.is_in(every, value_set=words).to_numpy(zero_copy_only=False)
            for size, those in starts.items():
                wanted = wanted | pc.is_in(pc.utf8_slice_codeunits(every, 0, size), value_set=pa.array(those, pa.string())).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(sizes)), sizes)
            kept = wanted[code] if len(code) else np.zeros(0, bool)
            pair = np.unique(row[kept] * max(1, len(every)) + code[kept])
            n = np.bincount(pair % max(1, len(every)), minlength=len(every))
            some = np.nonzero(n)[0]
            n_tokens = len(flat) - int(pc.sum(pc.equal(flat, "")).as_py() or 0)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*every.take(pa.array(some)).to_pylist(), None], pa.string()),
                    pa.array([*n[some].tolist(), len(sizes)], pa.int64()),
                    pa.array([*[0] * len(some), n_tokens], pa.int64()),
                ],
                ["term", "n", "size"],
            )

    found = texts.select("toks").mapInArrow(count, "term string, n long, size long")
    return found.groupBy("term").agg(F.sum("n").alias("n"), F.sum("size").alias("size"))


def scan_scores(spec: TableSpec, clauses: DataFrame, k: int, cfg: RetrievalConfig) -> DataFrame | None:
    """``(query_id, pk, score_ft)`` holding every query's best ``k`` rows, ties at the end included.
    ``clauses``: ``operators.boolean.parse_boolean``, stored. None when they do not fit the broadcast
    budget, or when queries share an id."""
    spark = clauses.sparkSession
    size = clauses.agg(
        F.count("*").alias("n"), F.count_distinct(F.struct("query_id", "term_no")).alias("keys"), F.coalesce(F.sum(F.size("toks")), F.lit(0)).alias("tokens")
    ).first()
    if size.n != size["keys"] or (size.n + size.tokens) * TOKEN_BYTES > cfg.broadcast_max_bytes:
        return None
    known = clauses.where("query_id is not null").orderBy("query_id", "term_no").collect()
    ids = {q: n for n, q in enumerate(dict.fromkeys(c.query_id for c in known))}
    rows = [(ids[c.query_id], c.op, c.toks, c.exact, c.prefix, c.kind == "phrase") for c in known]
    texts = doc_tokens(spec, cfg)
    counts = store_once(counted_terms(texts, sorted({t for c in known for t in c.exact}), sorted({c.prefix for c in known} - {None})), "term-counts")
    total = counts.where("term is null").first()
    n_docs, n_tokens = (total.n, total["size"]) if total else (0, 0)
    words = spark.createDataFrame([(t,) for t in sorted({t for c in known for t in c.exact})], "term string")
    exact = counts.join(F.broadcast(words), "term").select("term", "n").collect()  # no more than the queries' words
    under = counts.where("term is not null").join(F.broadcast(words), "term", "left_anti").select("term", "n")
    extra = under.orderBy(F.col("n").desc(), "term").limit(MOST_TERMS + 1).collect() if any(c.prefix is not None for c in known) else []
    most, n_extra = cfg.broadcast_max_bytes // ENTRY_BYTES, MOST_TERMS
    while True:
        given = sorted((c.term, c.n) for c in exact + extra[:n_extra])
        df = np.array([n for _, n in given], float)
        plan = Plan(rows, [t for t, _ in given], np.log(1.0 + (n_docs - df + 0.5) / (df + 0.5)), len(ids), most)
        if plan.entries <= most or n_extra == 0:
            break
        n_extra //= 8
    if plan.entries > most:
        return None
    plan.gain, plan.left_out = cfg.bm25_k1 + 1.0, len(extra) > n_extra
    idf = lambda n: float(np.log(1.0 + (n_docs - n + 0.5) / (n + 0.5)))
    low, high = (idf(extra[n_extra].n), idf(1)) if plan.left_out else (0.0, 0.0)
    k1, b, columns = cfg.bm25_k1, cfg.bm25_b, len(text_columns(spec, cfg.fulltext_columns))
    average = n_tokens / n_docs if n_tokens else 1.0
    shared = spark.sparkContext.broadcast(plan)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        terms = pa.array(plan.terms, pa.string())
        best = np.full((plan.n_queries, k), -np.inf)
        for batch in batches:
            sizes, flat = token_arrays(batch)
            if len(flat) == 0 or plan.n_queries == 0:
                continue
            coded = flat.dictionary_encode()
            every, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            number = pc.fill_null(pc.index_in(every, value_set=terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            others = Lists(len(every), zip(*plan.beginnings(every, number), strict=True)) if plan.left_out else None
            ends, kept = np.cumsum(sizes), []
            for at in range(0, len(sizes), plan.rows):
                own = sizes[at : at + plan.rows]
                row = np.repeat(np.arange(len(own)), own)
                length = k1 * (1.0 - b + b * (own - columns) / average)
                code = codes[ends[at] - sizes[at] : ends[at + len(own) - 1]]
                s, cell, token, part = plan.scores(row, number[code], len(own), length, code, others)
                added = np.bincount(cell, weights=part, minlength=s.size).reshape(s.shape)
                best = np.partition(np.concatenate([best, (s + low * added).T], axis=1), len(own), axis=1)[:, len(own) :]
                r, q = np.nonzero(np.isfinite(s) & (s + high * added >= best.min(axis=1) - MARGIN))
                by_cell = Lists(s.size, zip(cell, range(len(cell)), strict=True)) if len(cell) else None
                place, x = by_cell.of(r * plan.n_queries + q) if by_cell else (np.zeros(0, np.int64),) * 2
                kept.append((q, r + at, s[r, q], (s + high * added)[r, q], np.bincount(place, minlength=len(r)), token[x], part[x]))
            q, r, score, most, n, token, part = (np.concatenate(x) for x in zip(*kept, strict=True))
            still = most >= best.min(axis=1)[q] - MARGIN
            token, part = (x[np.repeat(still, n)] for x in (token, part))
            offsets = pa.array(np.concatenate([[0], np.cumsum(n[still])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(q[still].astype(np.int32)), batch.column(batch.schema.get_field_index("pk")).take(pa.array(r[still])), pa.array(score[still]),
                    pa.ListArray.from_arrays(offsets, every.take(pa.array(token))), pa.ListArray.from_arrays(offsets, pa.array(part)),
                ],
                ["q", "pk", "score_ft", "others", "parts"],
            )

    found = texts.mapInArrow(score, "q int, pk string, score_ft double, others array<string>, parts array<double>")
    if plan.left_out:
        found = store_once(found.withColumn("did", F.monotonically_increasing_id()), "open-scores")
        each = found.select("did", F.explode(F.arrays_zip("others", "parts")).alias("x")).select("did", F.col("x.others").alias("term"), F.col("x.parts").alias("part"))
        exactly = F.log(1.0 + (F.lit(n_docs) - F.col("n") + 0.5) / (F.col("n") + 0.5))
        sums = each.join(counts.select("term", "n"), "term").groupBy("did").agg(F.sum(exactly * F.col("part")).alias("more"))
        found = found.join(sums, "did", "left").withColumn("score_ft", F.col("score_ft") + F.coalesce("more", F.lit(0.0)))
    kind = clauses.schema["query_id"].dataType.simpleString()
    names = spark.createDataFrame([(n, q) for q, n in ids.items()], f"q int, query_id {kind}")
    return found.join(F.broadcast(names), "q").select("query_id", "pk", "score_ft")
