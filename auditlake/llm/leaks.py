"""Evaluation texts inside training text: latent semantic retrieval, then checks on the words.

The test items are the stated query set; every document is searched in one pass. Words become numbers in
the items' vocabulary when the texts are read, once. Passages are windows of words, weighted by TF-IDF
(document frequencies over all documents) and projected by a distributed randomised SVD of passages of
items and documents. A document's passage finds item passages by cosine in the cells of the latent space
nearest to it; the pair then has to pass a check of the words themselves.

A common run of ``RUN`` words lies whole in a passage of either side: passages are ``WINDOW`` long, start
every ``STRIDE`` = WINDOW - RUN + 1 words and end with the text. The two passages share at least those
words of ``WINDOW``; that their cosine passes ``NEAR`` and their cells are probed is measured, not proven.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.session import materialize

#: Words in a row that make a leak.
RUN = 12
#: Words of a passage and from one to the next.
WINDOW = 16
STRIDE = WINDOW - RUN + 1
#: Dimensions of the latent space, and columns beyond them in the random range finder.
DIMS, EXTRA = 48, 16
POWER_ROUNDS = 2
#: Documents whose passages the space is fitted on beside all items: the least by a hash of their id. The
#: search covers all documents.
FIT_DOCS = 2000
#: Least cosine of a candidate for a verbatim leak; cells of the latent space (of root n) that are searched.
NEAR, PROBES = 0.6, 8
#: Item passages searched in one pass over the numbered documents; more items make more passes.
MAX_WINDOWS = 400_000
#: Paraphrases: words per window, each with a step of a quarter; least cosine of a candidate, least common
#: subsequence. The shorter window is for reworded parts of ``PARA_SIZES[-1]`` words or more.
PARA_SIZES, PARA_NEAR, PARA_LCS = (32, 16), 0.4, 0.6
#: Largest table of items by words.
MAX_CELLS = 20_000_000

_WORD = re.compile(r"[^\W_]+")
_TAG = re.compile(r"</?[a-zA-Z!][^<>]*>")


def words(text: str | None) -> list[str]:
    """Runs of letters and digits in case-folded text without HTML tags and entities."""
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    return _WORD.findall(text.casefold())


def windows(starts: np.ndarray, size: int, step: int, partial: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Text and first word of each window inside each text.

    ``partial`` adds one for shorter texts and one that ends with the text, so that every word is in one.
    """
    lengths = np.diff(starts)
    n = np.where(lengths >= size, (lengths - size + (step - 1) * partial) // step + 1, ((lengths > 0) & partial).astype(int))
    text = np.repeat(np.arange(len(lengths)), n)
    at = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    return text, starts[text] + np.minimum(at * step, np.maximum(lengths[text] - size, 0))


def _numbered(vocabulary, counted: int, stretches: bool):
    """Number each text's words (-1: unknown), and count documents by word for the first ``counted`` numbers.

    With ``stretches`` only runs of at least ``RUN`` known words are kept, a -1 between them.
    """

    def kept(codes: np.ndarray) -> np.ndarray:
        known = np.r_[False, codes >= 0, False]
        begin, end = np.nonzero(known[1:] & ~known[:-1])[0], np.nonzero(known[:-1] & ~known[1:])[0]
        parts = [codes[i : j + 1] for i, j in zip(begin, end, strict=True) if j - i >= RUN]
        return np.concatenate(parts)[:-1] if parts else codes[:0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary.value.get
        df, docs = np.zeros(counted, np.int64), 0
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                codes = np.array([get(w, -1) for w in words(t)], np.int32)
                docs += bool(len(codes))
                seen = np.unique(codes)
                df[seen[(seen >= 0) & (seen < counted)]] += 1
                rows.append(kept(np.r_[codes, np.int32(-1)]) if stretches else codes)
            ends = np.cumsum([0] + [len(r) for r in rows])
            flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32())), pa.nulls(len(rows), pa.binary()), pa.nulls(len(rows), pa.int64())], names=["doc_id", "codes", "df", "docs"])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.int32())), pa.array([df.tobytes()], pa.binary()), pa.array([docs], pa.int64())], names=["doc_id", "codes", "df", "docs"])

    return run


def _added(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs = np.zeros(size, np.int64), 0
        for b in batches:
            for d, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                df, docs = df + np.frombuffer(d, np.int64), docs + n
        yield pa.RecordBatch.from_arrays([pa.array([df.tobytes()], pa.binary()), pa.array([docs], pa.int64())], names=["df", "docs"])

    return run


def numbered(docs: DataFrame, vocabulary: dict[str, int], counted: int, stretches: bool) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, codes) of every document, and the smoothed IDF of each counted word over all non-empty ones.

    Texts are read once; each task adds one array of counts, and at most 16 sums reach the driver.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    read = materialize(docs.select("doc_id", "text").mapInArrow(_numbered(shared, counted, stretches), "doc_id bigint, codes array<int>, df binary, docs bigint"), "numbered")
    df, total = np.zeros(counted), 0
    for r in read.where("df is not null").select("df", "docs").coalesce(16).mapInArrow(_added(counted), "df binary, docs bigint").collect():
        df, total = df + np.frombuffer(r["df"], np.int64), total + r["docs"]
    return read.where("df is null and size(codes) > 0").select("doc_id", "codes"), np.log((total + 1) / (df + 1)) + 1


def _tfidf(rows: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Weight of each word of each window so that windows have unit length; -1 weighs nothing."""
    w = np.where(rows >= 0, idf[rows], 0.0)
    order = np.argsort(rows, axis=1, kind="stable")
    sorted_rows, sorted_w = np.take_along_axis(rows, order, 1), np.take_along_axis(w, order, 1)
    same = np.zeros(rows.shape[0])
    run = np.zeros(rows.shape[0])
    for j in range(rows.shape[1]):  # repeated words add up before squaring
        run = np.where((j > 0) & (sorted_rows[:, j] == sorted_rows[:, j - 1]), run, 0.0)
        same += (run + sorted_w[:, j]) ** 2 - run**2
        run = run + sorted_w[:, j]
    return w / np.sqrt(np.maximum(same, 1e-12))[:, None]


def _gram(basis, idf):
    """One partition's share of A^T (A B) and of (A B)^T (A B), as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, weights = basis.value, idf.value
        left, small = np.zeros(b.shape), np.zeros((b.shape[1], b.shape[1]))
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pc.list_flatten(batch.column(0)).to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            w = _tfidf(rows, weights)
            y = np.einsum("ij,ijk->ik", w, b[rows])
            small += y.T @ y
            for j in range(rows.shape[1]):
                np.add.at(left, rows[:, j], w[:, j, None] * y)
        yield pa.RecordBatch.from_arrays([pa.array([left.tobytes()], pa.binary()), pa.array([small.tobytes()], pa.binary())], names=["left", "small"])

    return run


def latent_space(passages: DataFrame, size: int, idf: np.ndarray, dims: int = DIMS, seed: int = 11) -> np.ndarray:
    """Right singular vectors (words x dims) of the TF-IDF matrix of ``passages`` (codes array<int>).

    Randomised range finder with power rounds: each task multiplies its rows into one words x columns
    matrix; the driver adds those of at most 16 tasks. Words are those of the items, so it is bounded.
    """
    sc = passages.sparkSession.sparkContext
    dims = max(1, min(dims, size))
    cols = min(size, dims + EXTRA)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, cols)))[0]
    few = materialize(passages, "passages").coalesce(16)
    for _ in range(POWER_ROUNDS + 1):
        shared = sc.broadcast(basis), sc.broadcast(idf)
        left, small = np.zeros(basis.shape), np.zeros((cols, cols))
        for r in few.mapInArrow(_gram(*shared), "left binary, small binary").toLocalIterator():
            left += np.frombuffer(r["left"]).reshape(left.shape)
            small += np.frombuffer(r["small"]).reshape(small.shape)
        last = basis
        basis = np.linalg.qr(left)[0]
    values, vectors = np.linalg.eigh(small)
    return (last @ vectors[:, np.argsort(-values)])[:, :dims]


def project(rows: np.ndarray, idf: np.ndarray, space: np.ndarray) -> np.ndarray:
    """Unit vectors of windows (codes, -1 unknown) in the latent space."""
    w = _tfidf(rows, idf).astype(np.float32)
    out = np.zeros((len(rows), space.shape[1]), np.float32)
    for j in range(rows.shape[1]):
        out += w[:, j, None] * space[rows[:, j]]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def common_run(a: list, b: list, at_least: int = RUN) -> bool:
    """Whether both have ``at_least`` words in a row in common."""
    grams = {tuple(b[i : i + at_least]) for i in range(len(b) - at_least + 1)}
    return any(tuple(a[i : i + at_least]) in grams for i in range(len(a) - at_least + 1))


def subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence of words."""
    places: dict = {}
    for j, y in enumerate(b):
        places[y] = places.get(y, 0) | 1 << j
    every = free = (1 << len(b)) - 1  # a bit per word of b, cleared where the length grows
    for x in a:
        met = free & places.get(x, 0)
        free = (free + met | free - met) & every
    return len(b) - free.bit_count()


def _texts(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all texts of a batch in a row, and where each starts, with the end."""
    codes = b.column("codes")
    return pc.list_flatten(codes).to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(pc.list_value_length(codes).to_numpy(zero_copy_only=False))]


class Cells:
    """Item passages in the cells of their latent space, by spherical k-means; root n cells."""

    def __init__(self, vectors: np.ndarray, rounds: int = 8, seed: int = 5):
        rng = np.random.default_rng(seed)
        k = max(1, math.isqrt(len(vectors)))
        self.centres = vectors[rng.choice(len(vectors), k, replace=False)]
        for _ in range(rounds):
            at = self.cell_of(vectors)
            sums = np.zeros_like(self.centres)
            np.add.at(sums, at, vectors)
            sums[np.bincount(at, minlength=k) == 0] = vectors[rng.integers(len(vectors))]
            self.centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
        at = self.cell_of(vectors)
        self.members = [np.nonzero(at == c)[0] for c in range(k)]
        self.vectors = [vectors[m].T.copy() for m in self.members]

    def cell_of(self, vectors: np.ndarray) -> np.ndarray:
        out = np.zeros(len(vectors), np.int64)
        for k in range(0, len(vectors), 8192):
            out[k : k + 8192] = (vectors[k : k + 8192] @ self.centres.T).argmax(axis=1)
        return out

    def near(self, y: np.ndarray, least: float, probes: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, item passage) pairs with a cosine of ``least`` in the ``probes`` cells nearest to the row."""
        to = y @ self.centres.T
        probes = min(probes, to.shape[1])
        chosen = np.zeros(to.shape, bool)
        np.put_along_axis(chosen, np.argpartition(-to, probes - 1, axis=1)[:, :probes], True, axis=1)
        rows, found = [], []
        for c, members in enumerate(self.members):
            at = np.nonzero(chosen[:, c])[0]
            if len(at) and len(members):
                r, m = np.nonzero(y[at] @ self.vectors[c] >= least)
                rows.append(at[r])
                found.append(members[m])
        return (np.concatenate(rows), np.concatenate(found)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _search(shared):
    """Verbatim leaks: candidates by cosine in the nearest cells, then the words of both, then the common run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        space, idf, cells, owner = s["space"].astype(np.float32), s["idf"], s["cells"], s["indexes"][WINDOW][1]
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            codes, starts = _texts(b)
            text, first = windows(starts, WINDOW, STRIDE, partial=True)
            codes_end = np.r_[codes, np.full(WINDOW, -1, np.int32)]
            pairs: set[tuple[int, int]] = set()
            for k in range(0, len(first), 8192):
                rows = _rows(codes_end, starts, text[k : k + 8192], first[k : k + 8192], WINDOW)
                full = np.nonzero((rows >= 0).sum(axis=1) >= RUN)[0]
                rows, of = rows[full], text[k : k + 8192][full]
                w, i = cells.near(project(rows, idf, space), NEAR, PROBES)
                o = owner[i]
                once = np.unique(w * (len(s["items"]) + 1) + o)
                w, o = once // (len(s["items"]) + 1), once % (len(s["items"]) + 1)
                held = s["members"].get(o, rows[w]) >= RUN
                pairs |= set(zip(of[w[held]].tolist(), o[held].tolist(), strict=True))
            hits = sorted((t, o) for t, o in pairs if common_run(codes[starts[t] : starts[t + 1]].tolist(), s["passages"][o]))
            yield pa.RecordBatch.from_arrays([pa.array([ids[t] for t, _ in hits], pa.int64()), pa.array([s["items"][o] for _, o in hits], pa.int64())], names=["doc_id", "item_id"])

    return run


def _answered(text: list[int], answer: list[int]) -> bool | None:
    """Whether the answer's words stand in the text in a row; None if the item has no answer."""
    return any(text[i : i + len(answer)] == answer for i in range(len(text) - len(answer) + 1)) if answer else None


def _rows(codes: np.ndarray, starts: np.ndarray, text: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """Word codes of windows, -1 beyond the end of their text; ``codes`` has ``size`` more at its end."""
    at = first[:, None] + np.arange(size)
    return np.where(at < starts[text + 1][:, None], codes[at], -1)


def _near(s: dict, codes: np.ndarray, starts: np.ndarray, size: int) -> Iterator[tuple[int, int, int, float]]:
    """(text, first word, item number, cosine) of windows near an item with enough of its words to pass.

    The cosine is that of every ``size // 4``-th window; those between follow the nearest one.
    """
    space, idf, (index, owner) = s["space"].astype(np.float32), s["idf"], s["indexes"][size]
    index, lengths = index.T.copy(), s["lengths"]
    codes = np.r_[np.where(codes < len(idf), codes, -1), np.full(size, -1, np.int32)]
    group = np.nonzero(np.r_[True, owner[1:] != owner[:-1]])[0]
    text, first = windows(starts, size, size // 4, partial=True)
    shifts = np.arange(size // 4) - size // 8
    length = np.minimum(size, starts[text + 1] - first)
    step = max(64, min(2048, 20_000_000 // max(1, index.shape[1])))
    for k in range(0, len(first), step):
        rows = _rows(codes, starts, text[k : k + step], first[k : k + step], size)
        ok = np.nonzero((rows >= 0).sum(1) >= PARA_LCS * np.minimum(length[k : k + step], lengths.min()) - size // 8 - 1e-9)[0]
        if not len(ok):
            continue
        cos = np.maximum.reduceat(project(rows[ok], idf, space) @ index, group, axis=1)
        w, o = np.nonzero(cos >= PARA_NEAR)
        at, c, o = ok[w], cos[w, o], owner[group][o]
        # The subsequence is no longer than the number of words that the item has, too; shifts add few.
        held = s["members"].get(o, rows[at]) >= PARA_LCS * np.minimum(length[k + at], lengths[o]) - size // 8 - 1e-9
        at, o, c = at[held], o[held], c[held]
        begin = (first[k + at][:, None] + shifts).ravel()
        at, o, c = (np.repeat(x, len(shifts)) for x in (at, o, c))
        t, n = text[k + at], length[k + at]
        inside = (begin >= starts[t]) & (begin + n <= starts[t + 1])
        t, begin, n, o, c = t[inside], begin[inside], n[inside], o[inside], c[inside]
        held = s["members"].get(o, _rows(codes, starts, t, begin, size)) >= PARA_LCS * np.minimum(n, lengths[o]) - 1e-9
        yield from zip(t[held].tolist(), begin[held].tolist(), o[held].tolist(), c[held].tolist(), strict=True)


class Members:
    """Which words each item's passage has: one table if it is small, else sorted keys."""

    def __init__(self, passages: list[np.ndarray], size: int):
        self.size = size
        self.keys = np.unique(np.concatenate([np.asarray(p, np.int64) + k * size for k, p in enumerate(passages)]))
        self.table = None
        if len(passages) * (size + 1) <= MAX_CELLS:
            self.table = np.zeros((len(passages), size + 1), bool)  # the last column, -1, stands for unknown words
            self.table[self.keys // size, self.keys % size] = True

    def get(self, items: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Number of words of each window that its item has."""
        if self.table is not None:
            return self.table[items[:, None], rows].sum(1)
        keys = np.where(rows >= 0, items[:, None] * self.size + rows, -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return (self.keys[at] == keys).sum(1)


def _rephrased(shared):
    """Paraphrases: passages near an item whose words largely keep the item's order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            codes, starts = _texts(b)
            split: dict[int, list[int]] = {}
            best: dict[tuple[int, int], tuple[float, float]] = {}
            for size in PARA_SIZES:
                for t, at, o, c in _near(s, codes, starts, size):  # the words' order decides at every window
                    mine = split.get(t) or split.setdefault(t, codes[starts[t] : starts[t + 1]].tolist())
                    part = mine[at - starts[t] :][:size]
                    share = subsequence(part, s["passages"][o]) / min(len(part), len(s["passages"][o]))
                    if share >= PARA_LCS and (share, c) > best.get((t, o), (0.0, 0.0)):
                        best[t, o] = share, c
            out = [(ids[t], s["items"][o], c, share, common_run(split[t], s["passages"][o]), _answered(split[t], s["answers"][o])) for (t, o), (share, c) in sorted(best.items())]
            cols = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_(), pa.bool_()), strict=True)], names=["doc_id", "item_id", "cosine", "lcs_share", "verbatim", "answer_found"])

    return run


class Items:
    """The query set with its words numbered: those of passages first, then those of answers alone."""

    def __init__(self, items: DataFrame, answers: bool):
        rows = [(r["item_id"], words(r["passage"]), words(r["answer"]) if answers else []) for r in items.select("item_id", "passage", "answer").where("item_id is not null").orderBy("item_id").toLocalIterator()]
        rows = [r for r in rows if r[1]]
        known = sorted({w for _, ws, _ in rows for w in ws})
        self.counted = len(known)
        self.vocabulary = {w: i for i, w in enumerate(known + sorted({w for _, _, ws in rows for w in ws} - set(known)))}
        self.ids = [i for i, _, _ in rows]
        self.passages = [[self.vocabulary[w] for w in ws] for _, ws, _ in rows]
        self.answers = [[self.vocabulary[w] for w in ws] for _, _, ws in rows]

    def blocks(self) -> Iterator[slice]:
        """Slices of at most ``MAX_WINDOWS`` words."""
        begin, n = 0, 0
        for k, p in enumerate(self.passages):
            if k > begin and n + len(p) > MAX_WINDOWS:
                yield slice(begin, k)
                begin, n = k, 0
            n += len(p)
        if self.passages:
            yield slice(begin, len(self.passages))


def _cut(passages: list[list[int]], size: int, step: int, partial: bool) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of the windows of passages, and the place of each one's passage."""
    codes = np.array([c for p in passages for c in p], np.int32)
    starts = np.cumsum([0] + [len(p) for p in passages])
    text, first = windows(starts, size, step, partial)
    return _rows(np.r_[codes, np.full(size, -1, np.int32)], starts, text, first, size), text


def _windowed(size: int, counted: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, starts = _texts(b)
            text, first = windows(starts, size, size, True)
            rows = _rows(np.r_[np.where(codes < counted, codes, -1), np.full(size, -1, np.int32)], starts, text, first, size)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, size), pa.int32()), pa.array(rows.ravel().astype(np.int32)))], names=["codes"])

    return run


def _over_items(docs: DataFrame, items: DataFrame, sizes: dict[int, int], verbatim: bool, search, schema: str) -> DataFrame:
    """Search all documents for the items; the space is fitted on passages of the first of ``sizes`` (size: step)."""
    spark = docs.sparkSession
    known = Items(items, not verbatim)
    size = next(iter(sizes))
    if not known.ids:
        return spark.createDataFrame([], schema)
    read, idf = numbered(docs, known.vocabulary, known.counted, verbatim)
    own, _ = _cut(known.passages, size, sizes[size], True)
    few = read.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_DOCS).mapInArrow(_windowed(size, known.counted), "codes array<int>")
    passages = spark.createDataFrame(pa.table({"codes": pa.array(own.tolist(), pa.list_(pa.int32()))})).unionByName(few)
    space = latent_space(passages, known.counted, idf)
    out = None
    for block in known.blocks():
        mine = known.passages[block]
        indexes = {n: (project(rows, idf, space.astype(np.float32)), owner) for n, step in sizes.items() for rows, owner in [_cut(mine, n, step, True)]}
        found = {"idf": idf, "space": space, "indexes": indexes, "items": known.ids[block], "passages": mine, "answers": known.answers[block], "lengths": np.array([len(p) for p in mine]), "members": Members([np.array(p) for p in mine], known.counted)}
        if verbatim:
            found["cells"] = Cells(indexes[size][0])
        part = read.mapInArrow(search(spark.sparkContext.broadcast(found)), schema)
        out = part if out is None else out.unionByName(part)
    return out


def verbatim_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): documents with at least ``RUN`` words in a row of an item's passage.

    Null and empty texts and passages give no rows; repeated documents give a row each.
    """
    return _over_items(docs, items, {WINDOW: STRIDE}, True, _search, "doc_id bigint, item_id bigint")


def paraphrases(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Document passages close to an item in meaning and word order, with what the checks found.

    ``lcs_share`` is the longest common subsequence by the shorter side; ``answer_found`` is null where
    the item has no answer.
    """
    return _over_items(docs, items, {size: size // 4 for size in PARA_SIZES}, False, _rephrased, "doc_id bigint, item_id bigint, cosine double, lcs_share double, verbatim boolean, answer_found boolean")
