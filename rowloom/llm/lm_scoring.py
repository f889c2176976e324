"""Language-model scoring by a hierarchical Pitman-Yor model of word pairs.

Every previous token has a restaurant of its own, of the words seen after it in the training documents; the
start of a text is a token too.  All of them share one parent, the root restaurant of single words, whose
base is uniform over the known words and one unknown.  The seating is sampled by Gibbs moves
(:mod:`rowloom.llm.pitman_yor`) and the predictive probabilities are averaged over the last sweeps.

1. Scan tasks count their documents in batches: the pairs (previous token, token), how often the training
   documents have each, and which documents hold it.  Pairs are dealt to buckets by the previous token, so a
   restaurant lies in one bucket.  A token with more than a bucket's share of the corpus has its pairs dealt over all buckets.
2. The counts of all batches are merged by bucket.
3. Rounds: every bucket sends the tables of its words to the word's root task, which seats the root's customers and
   sends back the word's part of the root; then the buckets seat their customers anew, from where they sat.  The tables of
   tokens that are dealt over all buckets are added up on the same way.
4. After the last round each bucket answers the batches' pairs with their probabilities, and every batch adds them
   up by document.

Buckets go by the size of the corpus and have random streams of their own, so the scores don't depend on the number of
shuffle partitions.

Defined cases: a null text counts as empty and has one token, its end; ids may be null (then held out is
false); rows that repeat an id are scored one by one; a table without training documents gives uniform
probabilities; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import cut_lineage, free_shuffles, shuffle_width, table, tidy
from rowloom.llm.pitman_yor import DISCOUNT, STRENGTH, Seating, sample_contexts

#: Tokens that a scan task counts at once.
BATCH = 4_000_000
#: Bytes of text that make one bucket.
BUCKET_BYTES = 8_000_000
#: Rounds of exchange with the root, sweeps of a round, and the sweeps of the last one whose predictions are averaged.
ROUNDS, SWEEPS, KEPT = 2, 4, 3
_END = b"\n"  # no word is white space
_START = np.uint64(xxhash.xxh64_intdigest(b" ", 3))
_TAG = np.uint64(0xA5A5A5A5A5A5A5A5)
#: Kinds of rows, in the order in which a task has to see them.
_DOCUMENT, _PLACES, _MERGED, _STATE, _REPLY, _ASKED, _KNOWN, _REQUEST, _SUM, _ANSWER = range(10)
_NAMES = ["key", "kind", "at", "blob", "num", "row", "__id", "__held"]


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays with their types and lengths, compressed together, byte by byte of their numbers."""
    head = ";".join(f"{a.dtype.str},{len(a)}" for a in arrays).encode()
    planes = (np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() for a in arrays)
    return zstandard.compress(len(head).to_bytes(4, "little") + head + b"".join(planes), 3)


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(blob)
    at = 4 + int.from_bytes(raw[:4], "little")
    out = []
    for part in raw[4:at].decode().split(";"):
        kind, n = part.split(",")
        dtype, n = np.dtype(kind), int(n)
        planes = np.frombuffer(raw, np.uint8, n * dtype.itemsize, at).reshape(dtype.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(dtype).reshape(n))
        at += n * dtype.itemsize
    return out


def _short(p: np.ndarray) -> np.ndarray:
    """Numbers rounded to 16 bits after the leading one, whose last byte is zero and costs nothing when packed."""
    return ((p.astype(np.float32).view(np.uint32) + np.uint32(128)) & np.uint32(0xFFFFFF00)).view(np.float32)


def _narrow(a: np.ndarray) -> np.ndarray:
    """The same whole numbers in the smallest unsigned type."""
    most = int(a.max(initial=0))
    return a.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _deal(u: np.ndarray, w: np.ndarray, buckets: int, spread: np.ndarray) -> np.ndarray:
    """The bucket of each pair."""
    return (_mix(np.where(np.isin(u, spread), u ^ _mix(w), u)) % np.uint64(buckets)).astype(np.int64)


def _root_task(key: np.ndarray, buckets: int) -> np.ndarray:
    return (_mix(key ^ _TAG) % np.uint64(buckets)).astype(np.int64)


def _hash(token: bytes) -> int:
    return xxhash.xxh64_intdigest(token, 3)


def _tokens(text: str | None) -> list[bytes]:
    tokens = (text or "").encode().lower().split()
    tokens.append(_END)
    return tokens


def _rows(id_type, key, kind: int, at=0, blob=None, num=0.0, row=None, ids=None, held=None) -> pa.RecordBatch:
    """Rows of one kind; single values stand for all rows."""
    n = len(key)
    whole = lambda x, t: pa.array(np.broadcast_to(np.asarray(x), n), t)
    return pa.RecordBatch.from_arrays(
        [whole(key, pa.int64()), whole(kind, pa.int32()), whole(at, pa.int64()), pa.array(blob or [None] * n, pa.binary()), whole(num, pa.float64()),
         pa.nulls(n, pa.int32()) if row is None else whole(row, pa.int32()), pa.nulls(n, id_type) if ids is None else pa.array(ids, id_type),
         pa.nulls(n, pa.bool_()) if held is None else pa.array(held, pa.bool_())], names=_NAMES)


class _Words(dict):
    """Numbers of tokens in the order in which they come."""

    def __missing__(self, token: bytes) -> int:
        self[token] = n = len(self)
        return n


def _count(texts: list[np.ndarray], learn: np.ndarray, words: _Words, buckets: int, spread: np.ndarray):
    """One batch: where its pairs occur, and the pairs of each bucket with their training counts."""
    lengths = np.array([len(t) for t in texts])
    token = np.concatenate(texts)
    doc = np.repeat(np.arange(len(texts)), lengths)
    known = np.array([*map(_hash, words), int(_START)], np.uint64)
    order = np.argsort(known, kind="stable")  # numbers go by hash from here on
    rank = np.empty(len(order), np.int64)
    rank[order], known = np.arange(len(order)), known[order]
    token = rank[token]
    before = np.r_[0, token[:-1]]
    before[np.cumsum(lengths) - lengths] = rank[-1]
    key = before * len(known) + token
    by = np.argsort(key, kind="stable")
    key = key[by]
    entry = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    u, w = np.divmod(key[entry], len(known))
    bucket = _deal(known[u], known[w], buckets, spread)
    order = np.argsort(_narrow(bucket), kind="stable")  # by bucket, then by the hashes of both
    many = np.diff(np.r_[entry, len(key)])
    count = np.add.reduceat(learn[doc[by]].astype(np.int64), entry)[order]
    u, w, bucket, begin, many = u[order], w[order], bucket[order], entry[order], many[order]
    first = np.cumsum(many) - many
    doc = doc[by[np.repeat(begin - first, many) + np.arange(len(key))]]
    step = np.diff(doc, prepend=0)  # the documents of a pair, with repeats, as differences
    step[first] = doc[first]
    yield -1, _pack(_narrow(many), _narrow(step))
    there = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    for a, z in zip(there, np.r_[there[1:], len(bucket)], strict=True):
        new = np.flatnonzero(np.r_[True, u[a + 1 : z] != u[a : z - 1]])
        distinct, which = np.unique(w[a:z], return_inverse=True)
        yield int(bucket[a]), _pack(known[u[a:z][new]], _narrow(np.diff(np.r_[new, z - a])), known[distinct], _narrow(which), _narrow(count[a:z]))


def _scan(df: DataFrame, buckets: int, spread: np.ndarray) -> DataFrame:
    """Documents and places with a negative key for each batch, and the batches' pairs with their bucket."""

    def run(arrow):
        rows, texts, words, size, number = [], [], _Words(), 0, 0
        task, id_type = TaskContext.get().partitionId(), None

        def flush():
            nonlocal rows, texts, words, size, number
            batch = -1 - ((task << 32) + number)
            n = len(rows)
            yield _rows(id_type, [batch] * n, _DOCUMENT, batch, num=np.array([r[2] for r in rows], float), row=np.arange(n), ids=[r[0] for r in rows], held=[r[1] for r in rows])
            for bucket, blob in _count(texts, ~np.array([r[1] for r in rows]), words, buckets, spread):
                yield _rows(id_type, [batch if bucket < 0 else bucket], _PLACES if bucket < 0 else _ASKED, batch, [blob])
            rows, texts, words, size, number = [], [], _Words(), 0, number + 1

        for b in arrow:
            id_type = b.column("__id").type
            for i, held, text in zip(b.column("__id").to_pylist(), b.column("__held").to_pylist(), b.column("__text").to_pylist(), strict=True):
                tokens = _tokens(text)
                texts.append(np.array([words[t] for t in tokens], np.int64))
                rows.append((i, held, len(tokens)))
                size += len(tokens)
                if size >= BATCH:
                    yield from flush()
        if rows:
            yield from flush()

    return df.mapInArrow(tidy(run), _schema(df))


def _schema(df: DataFrame) -> str:
    return f"key long, kind int, at long, blob binary, num double, row int, __id {df.schema['__id'].dataType.simpleString()}, __held boolean"


def _by_key(each: Callable[..., Iterator[pa.RecordBatch]]):
    """``each(id_type, key, rows)`` for the adjacent rows of every key; a row is (kind, at, blob, num)."""

    def run(batches):
        key, rows, id_type = None, [], None
        for b in batches:
            id_type = b.column("__id").type
            for k, *row in zip(*(b.column(c).to_pylist() for c in ("key", "kind", "at", "blob", "num")), strict=True):
                if k != key and rows:
                    yield from each(id_type, key, rows)
                    rows = []
                key = k
                rows.append(row)
        if rows:
            yield from each(id_type, key, rows)

    return run


def _dealt(df: DataFrame, parts: int, each, schema: str) -> DataFrame:
    return df.repartition(parts, "key").sortWithinPartitions("key", "kind", "at", "row").mapInArrow(tidy(each), schema)


def _merge(buckets: int, spread: np.ndarray):
    """The pairs of a bucket from all batches, and for each batch where its pairs are among them."""

    def each(id_type, key, rows):
        us, ws, ns, sizes = [], [], [], []
        for _, _, blob, _ in rows:
            contexts, per, words, which, count = _unpack(blob)
            us.append(np.repeat(contexts, per.astype(np.int64)))
            ws.append(words[which])
            ns.append(count.astype(np.int64))
            sizes.append(len(which))
        u, w, n = np.concatenate(us), np.concatenate(ws), np.concatenate(ns)
        order = np.lexsort((w, u))
        u, w, n = u[order], w[order], n[order]
        new = np.r_[True, (u[1:] != u[:-1]) | (w[1:] != w[:-1])]
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        u, w, n = u[first], w[first], np.add.reduceat(n, first)
        b, words, contexts = _Bucket.made(u, w, n, buckets, spread)
        yield _rows(id_type, [key], _MERGED, 0, [b.packed()], float(n.sum()))
        yield from b.requests(id_type, key, np.minimum(n, 1), words, contexts)
        end = np.cumsum(sizes)
        for (_, batch, _, _), a, z in zip(rows, end - sizes, end, strict=True):
            yield _rows(id_type, [key], _ASKED, batch, [_pack(_narrow(np.diff(place[a:z], prepend=0)))])

    def run(batches):
        held: list[pa.RecordBatch] = []

        def flush(last: bool):
            whole = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            done = pa.compute.not_equal(whole.column("key"), whole.column("key")[-1])
            if not last:
                held.extend(whole.filter(pa.compute.invert(done)).to_batches())
                whole = whole.filter(done)
            yield from _by_key(each)(whole.to_batches())

        for b in batches:
            passing = pa.compute.less(b.column("key"), 0)  # documents and places
            if pa.compute.any(passing).as_py():
                yield b.filter(passing)
            rest = b.filter(pa.compute.invert(passing))
            if rest.num_rows:
                held.append(rest)
                if held[0].column("key")[0].as_py() != rest.column("key")[-1].as_py():
                    yield from flush(False)
        if held:
            yield from flush(True)

    return run


class _Bucket:
    """The pairs of a bucket: for each its context, its word and its customers, all as numbers within the bucket.

    Words are numbered by root task and hash, and so are the contexts that other buckets have too (``parted``).
    ``tasks`` are the root tasks, with the numbers of words and of such contexts that each has.
    """

    def __init__(self, blob: bytes):
        per, word, n, parted, self.tasks, self.words_of, self.parted_of = (x.astype(np.int64) for x in _unpack(blob))
        self.context, self.word, self.n = np.repeat(np.arange(len(per)), per), word, n.astype(np.float64)
        self.parted = parted
        self.customers = np.bincount(self.context, weights=self.n, minlength=len(per))

    @classmethod
    def made(cls, u: np.ndarray, w: np.ndarray, n: np.ndarray, buckets: int, spread: np.ndarray):
        """A bucket from pairs sorted by context, and the hashes of its words and parted contexts."""
        first = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
        contexts, (words, which) = u[first], np.unique(w, return_inverse=True)
        task = _root_task(words, buckets)
        to = np.argsort(task, kind="stable")
        back = np.empty(len(to), np.int64)
        back[to] = np.arange(len(to))
        parted = np.flatnonzero(np.isin(contexts, spread))
        parted = parted[np.argsort(_root_task(contexts[parted], buckets), kind="stable")]
        parted_task = _root_task(contexts[parted], buckets)
        tasks = np.union1d(task, parted_task)
        many = lambda t: np.diff(np.searchsorted(np.sort(t), np.r_[tasks, buckets]))
        blob = _pack(*map(_narrow, (np.diff(np.r_[first, len(u)]), back[which], n, parted, tasks, many(task), many(parted_task))))
        return cls(blob), words[to], contexts[parted]

    def packed(self) -> bytes:
        per = np.bincount(self.context)
        return _pack(*map(_narrow, (per, self.word, self.n, self.parted, self.tasks, self.words_of, self.parted_of)))

    def requests(self, id_type, key: int, tables: np.ndarray, words=None, contexts=None):
        """The tables of the words and of parted contexts to their root tasks; the first time with hashes and customers."""
        of_word = lambda x: np.bincount(self.word, weights=x, minlength=int(self.words_of.sum())).astype(np.int64)
        t, n = of_word(tables), of_word(self.n)
        ct = np.bincount(self.context, weights=tables, minlength=len(self.customers)).astype(np.int64)[self.parted]
        cn = self.customers.astype(np.int64)[self.parted]
        z, y = np.cumsum(self.words_of), np.cumsum(self.parted_of)
        for q, i, j, k, m in zip(self.tasks.tolist(), z - self.words_of, z, y - self.parted_of, y, strict=True):
            sent = [_narrow(t[i:j]), _narrow(ct[k:m])]
            if words is not None:
                sent += [words[i:j], contexts[k:m], _narrow(n[i:j]), _narrow(cn[k:m])]
            yield _rows(id_type, [q], _REQUEST, key, [_pack(*sent)], float(t[i:j].sum()))

    def take(self, replies: list[bytes], totals: dict, own_tables: np.ndarray) -> None:
        """The root's probability and the training count of each word, from replies in the order of root tasks."""
        left, count, tables, customers = (np.concatenate(x) for x in zip(*map(_unpack, replies), strict=True))
        self.parent = (left + totals["base"]) / totals["root"]
        self.count = count.astype(np.float64)
        mine = np.bincount(self.context, weights=own_tables, minlength=len(self.customers))[self.parted]
        self.elsewhere = np.zeros(len(self.customers))
        self.elsewhere[self.parted] = tables - mine
        self.served = self.customers.copy()
        self.served[self.parted] = customers


def _roots(totals: dict | None, number: int):
    """Seat the root's customers for the words of a root task and answer all buckets.

    In the first round, where the totals aren't known yet, every word has one table; the task then keeps which words
    each bucket asks for.
    """

    def each(id_type, key, rows):
        asked = [(at, _unpack(blob)) for kind, at, blob, _ in rows if kind == _REQUEST]
        t, ct = (np.concatenate([g[i] for _, g in asked]).astype(float) for i in (0, 1))
        if totals is None:
            (words, word), (contexts, context) = (np.unique(np.concatenate([g[i] for _, g in asked]), return_inverse=True) for i in (2, 3))
            n_words, n_contexts = len(words), len(contexts)
            count = np.bincount(word, weights=np.concatenate([g[4] for _, g in asked]), minlength=n_words).astype(np.int64)
            c_count = np.bincount(context, weights=np.concatenate([g[5] for _, g in asked]), minlength=n_contexts).astype(np.int64)
            yield _rows(id_type, [key], _KNOWN, -1, [_pack(_narrow(count), _narrow(c_count))])
        else:
            known = {at: _unpack(blob) for kind, at, blob, _ in rows if kind == _KNOWN}
            count, c_count = (x.astype(np.int64) for x in known[-1])
            n_words, n_contexts = len(count), len(c_count)
            word, context = (np.concatenate([np.cumsum(known[at][i].astype(np.int64)) for at, _ in asked]) for i in (0, 1))
        tables, c_tables = np.bincount(word, weights=t, minlength=n_words), np.bincount(context, weights=ct, minlength=n_contexts)
        seated = np.minimum(tables, 1)
        if totals is not None and n_words:
            seats, total = Seating(tables, DISCOUNT[1], np.random.default_rng([number, key, 1])), np.zeros(n_words)
            for s in range(SWEEPS):
                seats.sweep(np.full(n_words, totals["base"]))
                total += seats.tables if s >= SWEEPS - KEPT else 0
            seated = total / KEPT
        left = (tables - DISCOUNT[1] * seated).astype(np.float32)
        yield _rows(id_type, [key], _SUM, num=float(seated.sum()))
        a = x = 0
        for bucket, g in asked:
            i, j = word[a : a + len(g[0])], context[x : x + len(g[1])]
            a, x = a + len(i), x + len(j)
            yield _rows(id_type, [bucket], _REPLY, key, [_pack(left[i], _narrow(count[i]), c_tables[j], c_count[j])])
            if totals is None:  # both are sorted by hash, so the differences are small
                yield _rows(id_type, [key], _KNOWN, bucket, [_pack(_narrow(np.diff(i, prepend=0)), _narrow(np.diff(j, prepend=0)))])

    return _by_key(each)


def _seat(totals: dict, number: int, last: bool):
    """Seat a bucket's customers; then ask the root again, or answer the batches."""

    def each(id_type, key, rows):
        of = lambda kind: [r for r in rows if r[0] == kind]
        b = _Bucket(of(_MERGED)[0][2])
        seats = Seating(b.n, DISCOUNT[0], np.random.default_rng([number, key, 0]))
        for _, _, blob, _ in of(_STATE):
            seats.resume(*_unpack(blob))
        b.take([r[2] for r in of(_REPLY)], totals, seats.tables)
        p = sample_contexts(seats, b.context, b.n, b.parent[b.word], b.elsewhere, b.served, SWEEPS, KEPT if last else 0)
        if not last:
            yield _rows(id_type, [key], _STATE, blob=[_pack(*map(_narrow, seats.state()))], num=float(seats.tables.sum()))
            yield from b.requests(id_type, key, seats.tables)
            return
        p, count = _short(p), b.count[b.word].astype(np.int64)
        for _, batch, blob, _ in of(_ASKED):
            at = np.cumsum(_unpack(blob)[0].astype(np.int64))
            yield _rows(id_type, [batch], _ANSWER, key, [_pack(p[at], _narrow(count[at]))])

    return _by_key(each)


def _finish(totals: dict, id_col: str):
    """The sums of each document of a batch."""
    base_total = totals["tokens"] + 0.5 * (totals["vocabulary"] + 1)

    def emit(docs, places, answers):
        many, step = (x.astype(np.int64) for x in _unpack(places))
        p, count = (np.concatenate(x).astype(np.float64) for x in zip(*map(_unpack, answers), strict=True))
        begin, step = np.cumsum(many) - many, np.cumsum(step)
        doc = step - np.repeat(np.r_[0, step[begin[1:] - 1]], many)
        add = lambda x: np.bincount(doc, weights=np.repeat(x, many))
        tokens = docs.column("num").to_numpy().astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [docs.column("__id"), docs.column("__held"), pa.array(tokens), pa.array(np.rint(add((count > 0).astype(float))).astype(np.int64)),
             pa.array(np.full(len(tokens), int(totals["tokens"]))), pa.array(add(np.log10((count + 0.5) / base_total))), pa.array(add(np.log10(p)))],
            names=[id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    def run(batches):
        docs, places, answers, key = [], None, [], None
        for b in batches:
            kinds, keys = b.column("kind").to_numpy(), b.column("key").to_numpy()
            cut = np.flatnonzero(np.r_[True, (kinds[1:] != kinds[:-1]) | (keys[1:] != keys[:-1])]) if len(kinds) else []
            for a, z in zip(cut, np.r_[cut[1:], len(kinds)] if len(cut) else [], strict=True):
                if keys[a] != key and docs:
                    yield emit(pa.Table.from_batches(docs).combine_chunks().to_batches()[0], places, answers)
                    docs, answers = [], []
                key, part = keys[a], b.slice(a, z - a)
                if kinds[a] == _DOCUMENT:
                    docs.append(part)
                elif kinds[a] == _PLACES:
                    places = part.column("blob")[0].as_py()
                else:
                    answers += part.column("blob").to_pylist()
        if docs:
            yield emit(pa.Table.from_batches(docs).combine_chunks().to_batches()[0], places, answers)

    return run


def _frequent(slim: DataFrame, buckets: int) -> np.ndarray:
    """Hashes of the tokens with more than a bucket's share of all tokens, at most ``buckets`` of them."""
    if buckets == 1:
        return np.zeros(0, np.uint64)

    def run(batches):
        seen, n = Counter(), 0

        def flush():
            got = [(t, c) for t, c in seen.items() if 2 * buckets * c >= n] if n else []
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array([_hash(t) for t, _ in got] + [0], np.uint64).view(np.int64)), pa.array([c for _, c in got] + [n], pa.int64()),
                 pa.array([False] * len(got) + [True])], names=["token", "n", "all"])

        for b in batches:
            for text in b.column("__text").to_pylist():
                tokens = _tokens(text)
                seen.update(tokens)
                n += len(tokens)
                if n >= BATCH:
                    yield from flush()
                    seen, n = Counter(), 0
        yield from flush()

    counts = cut_lineage(slim.select("__text").mapInArrow(tidy(run), "token long, n long, all boolean").groupBy("token", "all").agg(F.sum("n").alias("n")))
    whole = counts.filter("all").first()
    found = counts.filter(~F.col("all") & (F.col("n") * buckets >= (whole["n"] if whole else 0))).select("token").collect()
    return np.sort(np.array([r["token"] for r in found], np.int64).view(np.uint64))


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out=None, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    parts = shuffle_width(df.sparkSession)
    held = F.coalesce(held_out if held_out is not None else F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 1, F.lit(False))
    slim = df.select(F.col(id_col).alias("__id"), held.alias("__held"), F.col(text_col).alias("__text"))
    buckets = 1 + int(slim.agg(F.sum(F.octet_length("__text"))).first()[0] or 0) // bucket_bytes
    spread = _frequent(slim, buckets)
    schema = _schema(slim)
    counted = cut_lineage(_dealt(_scan(slim, buckets, spread), parts, _merge(buckets, spread), schema))
    free_shuffles(df.sparkSession)
    of = lambda rows, kind: rows.filter(F.col("kind") == kind)
    merged = of(counted, _MERGED)
    tokens = float(merged.agg(F.sum("num")).first()[0] or 0)
    asked, state, known, seated, totals = of(counted, _REQUEST), None, None, None, None
    vocabulary, customers = 0, float(asked.agg(F.sum("num")).first()[0] or 0)
    for number in range(ROUNDS):
        replies = cut_lineage(_dealt(asked if known is None else asked.unionByName(known), parts, _roots(totals, number), schema))
        known = of(replies, _KNOWN) if known is None else known
        root_tables = float(of(replies, _SUM).agg(F.sum("num")).first()[0] or 0)
        vocabulary = vocabulary or int(root_tables)
        totals = {"tokens": tokens, "vocabulary": vocabulary, "root": STRENGTH[1] + customers, "base": (STRENGTH[1] + DISCOUNT[1] * root_tables) / (vocabulary + 1)}
        given = merged.unionByName(of(replies, _REPLY))
        given = given if state is None else given.unionByName(state)
        if number == ROUNDS - 1:
            asked = known = seated = None  # so that what was written out for them goes
        free_shuffles(df.sparkSession)
        if number < ROUNDS - 1:
            seated = cut_lineage(_dealt(given, parts, _seat(totals, number, False), schema))
            state, asked = of(seated, _STATE), of(seated, _REQUEST)
            customers = float(state.agg(F.sum("num")).first()[0] or 0)
    answers = _dealt(given.unionByName(of(counted, _ASKED)), parts, _seat(totals, ROUNDS, True), schema)
    answered = answers.unionByName(counted.filter("key < 0"))
    out = f"`{id_col}` {slim.schema['__id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return _dealt(answered, parts, _finish(totals, id_col), out)


def op10_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
