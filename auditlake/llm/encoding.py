"""Text that was decoded with the wrong character encoding: detection and repair.

A smoothed character trigram model is trained on clean words of all records. Each word with letters
beyond ASCII is scored under every candidate chain (encode with the wrong charset, decode with the
true one); a segment takes the chain whose total gain in log likelihood is largest, if it passes a
margin that is validated on held-out segments, clean ones and the same damaged on purpose.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.session import materialize

#: Charsets text may have been read with by mistake; bytes without a meaning pass through, as browsers do.
WRONG = ("cp1252", "iso8859-15", "cp1250", "iso8859-2", "cp1251", "koi8-r", "mac-roman", "cp437", "cp850", "cp866", "cp852", "cp1253", "cp1254", "cp1257", "mac-cyrillic", "iso8859-5", "latin-1")
#: Charsets the bytes may really have been in, besides UTF-8.
TRUE = ("cp1252", "cp1250", "iso8859-2", "cp1251", "koi8-r", "mac-roman", "cp437", "cp850", "cp866", "iso8859-5", "iso8859-7", "cp1255", "cp1256", "cp1257", "cp874", "shift_jis", "euc_jp", "gb18030", "big5", "euc_kr")
#: Multi-byte charsets that bytes may have been read with.
WRONG_MULTI = ("shift_jis", "euc_jp", "gb18030", "big5", "euc_kr")
#: Trigrams kept in the model, most frequent first: more than the letters of all living scripts make in practice.
MODEL_SIZE = 2_000_000
#: Mean log likelihood of a character that a word reaches in any language the model knows.
TYPICAL = -5.0
#: Gain in nats that a record's best chain must pass, where there are too few held-out segments to validate it.
MARGIN = 7.0
#: Margins to choose from; one record of so many is held out of the training for it; least held-out segments.
MARGINS, HELD_OUT, ENOUGH = tuple(x / 2 for x in range(8, 25)), 50, 200
#: The same while the model is still trained on some damaged words.
FIRST_MARGIN = 4.0
#: Rounds of decoding that may lie on top of each other.
DEPTH = 3

_QUOTED = re.compile(r"<code\b.*?</code\s*>", re.S | re.I)
_SPLIT = re.compile(r'[<>"]+')
_WORD = re.compile(r"[^\x00-\x20]+")


@lru_cache(maxsize=64)
def _bytes_of(charset: str) -> dict[int, int]:
    """Character -> byte of a single-byte charset; undefined bytes stand for the control of that number."""
    out = {}
    for i in range(256):
        try:
            c = bytes([i]).decode(charset)
        except UnicodeDecodeError:
            c = chr(i)
        out.setdefault(ord(c), i)
    return out


def encode(text: str, charset: str) -> bytes | None:
    """The bytes that read as ``text`` in ``charset``, or None."""
    if charset in WRONG_MULTI:
        try:
            return text.encode(charset)
        except UnicodeError:
            return None
    table = _bytes_of(charset)
    try:
        return bytes([table[ord(c)] for c in text])
    except KeyError:
        return None


def decode(raw: bytes, charset: str) -> str | None:
    try:
        return raw.decode(charset)
    except UnicodeError:
        return None


@lru_cache(maxsize=200_000)
def candidates(word: str) -> dict[str, list[str]]:
    """Decoded word -> the chains that give it; UTF-8 rounds repeat up to ``DEPTH`` times.

    Single-byte charsets are tried only on words of two characters or more: a lone sign could be any letter.
    """
    found: dict[str, list[str]] = {}
    level = [("", word)]
    for _ in range(DEPTH):
        deeper = {}
        for chain, text in level:
            for w in WRONG + (WRONG_MULTI if not chain else ()):
                raw = encode(text, w)
                t = decode(raw, "utf-8") if raw is not None else None
                if t is None or t == word:
                    continue
                name = f"{chain}{w}>utf-8;"
                found.setdefault(t, []).append(name)
                if not t.isascii():
                    deeper.setdefault(t, name)
        level = [(c, t) for t, c in deeper.items()]
    if len(word.strip("0123456789.,:;!?()%-+/'")) < 2:
        return found
    read: dict[bytes, list[str]] = {}  # many charsets give the same bytes
    for w in WRONG + (WRONG_MULTI if any(c >= "\u2e80" for c in word) else ()):  # those charsets give such signs
        if (raw := encode(word, w)) is not None:
            read.setdefault(raw, []).append(w)
    for raw, wrong in read.items():
        for true in TRUE:
            if (t := decode(raw, true)) is not None and t != word and (names := [f"{w}>{true};" for w in wrong if w != true]):
                found.setdefault(t, []).extend(names)
    return found


def spans(page: str) -> Iterator[tuple[int, int, str]]:
    """Where texts and attribute values outside code elements, comments and scripts too, stand, entities decoded."""
    begin = 0
    for m in [*_QUOTED.finditer(page), None]:
        end = m.start() if m else len(page)
        at = begin
        for cut in [*_SPLIT.finditer(page, begin, end), None]:
            stop = cut.start() if cut else end
            s = page[at:stop]
            if "&" in s:
                s = html.unescape(s)
            if not s.isascii():
                yield at, stop, s
            at = cut.end() if cut else stop
        begin = m.end() if m else end


def segments(page: str) -> list[str]:
    """Texts and attribute values outside code elements, comments and scripts too, entities decoded."""
    return [s for _, _, s in spans(page)]


def escaped(raw: str, text: str, fixed: str) -> str:
    """``fixed`` as it stands in html in place of ``raw``, which reads ``text``; words that stay keep their entities."""
    if raw == text:
        return fixed
    old, new = _WORD.findall(raw), _WORD.findall(fixed)
    if [html.unescape(w) for w in old] != _WORD.findall(text) or len(old) != len(new):
        return html.escape(fixed)
    words = iter([o if html.unescape(o) == n else html.escape(n) for o, n in zip(old, new, strict=True)])
    return _WORD.sub(lambda _: next(words), raw)


@lru_cache(maxsize=200_000)
def looks_damaged(word: str) -> bool:
    """Certain signs only: replacement characters, C1 controls, or bytes that are valid UTF-8."""
    if "�" in word or any("\x80" <= c <= "\x9f" for c in word):
        return True
    for w in ("cp1252", "iso8859-15", "cp1250", "cp1251", "mac-roman", "cp437", "cp850", "iso8859-2"):
        raw = encode(word, w)
        if raw is not None and decode(raw, "utf-8") is not None:
            return True
    return False


def trigrams(word: str) -> Iterator[str]:
    padded = f"  {word} "
    for i in range(len(padded) - 2):
        yield padded[i : i + 3]


class Model:
    """Interpolated trigram model over characters; digits count as one character."""

    def __init__(self, counts: dict[str, int]):
        self.three = counts
        self.context: dict[str, int] = defaultdict(int)
        self.two: dict[str, int] = defaultdict(int)
        self.one: dict[str, int] = defaultdict(int)
        self.mid: dict[str, int] = defaultdict(int)
        for g, n in counts.items():
            self.context[g[:2]] += n
            self.two[g[1:]] += n
            self.mid[g[1]] += n
            self.one[g[2]] += n
        self.total = sum(self.one.values()) or 1
        self.scores: dict[str, list[tuple[list[str], str, float]]] = {}
        self.best: dict[str, float] = {}

    def known(self, text: str) -> bool:
        return all(c in self.one or c.isascii() for c in text)

    def loglik(self, word: str) -> float:
        out = 0.0
        for g in trigrams(_digits(word)):
            p = 1e-7 + 0.1 * self.one.get(g[2], 0) / self.total
            if n := self.mid.get(g[1]):
                p += 0.3 * self.two.get(g[1:], 0) / n
            if n := self.context.get(g[:2]):
                p += 0.6 * self.three.get(g, 0) / n
            out += math.log(p)
        return out

    def gains(self, word: str) -> list[tuple[list[str], str, float]]:
        """(chains, decoded, gain) of every result that has only characters the model knows.

        A chain that uncovers replacement characters proves damage, though not what stood there.
        """
        found = self.scores.get(word)
        if found is None:
            base, found = None, []
            for t, chains in candidates(word).items():
                if "�" in t:
                    found.append((chains, t, 1e6))
                elif self.known(t):
                    base = self.loglik(word) if base is None else base
                    new = self.loglik(t)
                    if new < TYPICAL * (len(t) + 1):  # no language: only valid UTF-8 is evidence enough
                        chains = [c for c in chains if c.endswith(">utf-8;")]
                    if chains:
                        found.append((chains, t, new - base))
            if len(self.scores) > 200_000:
                self.scores.clear()
            if len(word) < 40:
                self.scores[word] = found
        return found


    def most(self, word: str) -> float:
        """The largest gain of any chain, 0 if none gains."""
        found = self.best.get(word)
        if found is None:
            found = max((g for _, _, g in self.gains(word)), default=0.0)
            if len(self.best) > 1_000_000:
                self.best.clear()
            found = self.best[word] = max(0.0, found)
        return found


def _digits(word: str) -> str:
    return re.sub(r"\d", "0", word)


def segment_chain(model: Model, segment: str, floor: float = -math.inf) -> tuple[str, float]:
    """Best chain of a segment and its gain; words that a chain can't change count nothing.

    Where the words' best gains together do not pass ``floor``, no chain can: then ("", that sum).
    """
    total: dict[str, float] = defaultdict(float)
    words = [w for w in _WORD.findall(segment) if not w.isascii()]
    if (most := sum(map(model.most, words))) <= floor:
        return "", most
    for word in words:
        for chains, _, gain in model.gains(word):
            for chain in chains:
                total[chain] += gain
    return max(total.items(), key=lambda x: x[1], default=("", 0.0))


def repair(model: Model, segment: str, chain: str) -> str:
    """Decode each word of the segment by the chain where that makes it likelier."""

    def one(m: re.Match) -> str:
        for chains, t, gain in model.gains(m.group(0)) if not m.group(0).isascii() else ():
            if chain in chains and gain > 0:
                return t
        return lone(m.group(0))

    def lone(word: str) -> str:
        """A single letter follows the chain of its segment, which its own likelihood could not show."""
        wrong, _, true = chain.rstrip(";").partition(">")
        if len(word.strip("0123456789.,:;!?()%-+/'")) != 1 or word.isascii() or true == "utf-8" or ";" in true:
            return word
        raw = encode(word, wrong)
        t = decode(raw, true) if raw is not None else None
        return t if t and any(c.isalpha() for c in t) and model.known(t) else word

    return _WORD.sub(one, segment)


# --- distributed training and scoring -----------------------------------------------------------


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct segments of each record that hold letters beyond ASCII; records without any are left out."""
    for b in batches:
        found = [list(dict.fromkeys(segments(p))) if p and not (p.isascii() and "&" not in p) else [] for p in b.column("html").to_pylist()]
        some = pa.array([bool(f) for f in found], pa.bool_())
        cols = [b.column(c).filter(some) for c in ("page_id", "declared", "held")]
        yield pa.RecordBatch.from_arrays([*cols, pa.array([f for f in found if f], pa.list_(pa.string()))], names=["page_id", "declared", "held", "segments"])


def _counter(model: Model | None):
    """Count trigrams of clean words; with a model, segments that it would repair are left out too."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(grams), pa.string()), pa.array(list(grams.values()), pa.int64())], names=["gram", "n"])

        for b in batches:
            words: Counter[str] = Counter()
            for s in pc.list_flatten(b.column(0)).to_pylist():
                if model is None or segment_chain(model, s, FIRST_MARGIN)[1] <= FIRST_MARGIN:
                    words.update(w for w in _WORD.findall(s) if not w.isascii())
            for w, n in words.items():
                if not looks_damaged(w):
                    for g in trigrams(_digits(w)):
                        grams[g] += n
            if len(grams) > 500_000:
                yield out()
                grams.clear()
        yield out()

    return count


def _misread(text: str) -> str:
    """The UTF-8 bytes of a text read as cp1252: damage on purpose."""
    table = {v: chr(k) for k, v in _bytes_of("cp1252").items()}
    return "".join(table[x] for x in text.encode("utf-8", "replace"))


def _gains(model):
    """How many clean and how many damaged held-out segments pass each margin, and how many there are (at -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, n = Model(model.value), Counter()
        for b in batches:
            for s in pc.list_flatten(b.column(0)).to_pylist():
                gain = segment_chain(m, s, MARGINS[0])[1]
                if any(looks_damaged(w) for w in _WORD.findall(s)) or gain > max(MARGINS):
                    continue  # damaged already
                bad = segment_chain(m, _misread(s), MARGINS[0])[1]
                n[-1.0] += 1
                n.update(x for x in MARGINS if gain > x)
                n.update(x for x in MARGINS if bad <= x)
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.float64()), pa.array(list(n.values()), pa.int64())], names=["margin", "errors"])

    return run


def validated_margin(held: DataFrame, model) -> float:
    """The margin with the fewest errors on held-out segments, clean ones and the same damaged on purpose.

    Of several as good the one nearest to ``MARGIN``, which also holds where there are fewer than ``ENOUGH``.
    """
    n = {r["margin"]: r["errors"] for r in held.select("segments").mapInArrow(_gains(model), "margin double, errors bigint").groupBy("margin").agg(F.sum("errors").alias("errors")).collect()}
    return MARGIN if n.get(-1.0, 0) < ENOUGH else min(MARGINS, key=lambda x: (n.get(x, 0), abs(x - MARGIN)))


def train_on(cut: DataFrame, size: int = MODEL_SIZE, rounds: int = 2) -> Model:
    """Count the trigrams of all clean words of ``segments``; the ``size`` most frequent make the model.

    The first round leaves out words with certain signs of damage, the second also the segments that
    the first model would repair. Counts are combined in each task before the shuffle.
    """
    model = None
    for _ in range(rounds):
        grams = cut.select("segments").mapInArrow(_counter(model), "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
        top = grams.orderBy(F.desc("n"), "gram").limit(size)
        model = Model({r["gram"]: r["n"] for r in top.toLocalIterator()})
    return model


def segmented(pages: DataFrame) -> DataFrame:
    """(page_id, declared, held, segments) of the records of (page_id, html, declared) with letters beyond ASCII."""
    held = F.pmod(F.xxhash64("page_id"), F.lit(HELD_OUT)) == 0
    return pages.select("page_id", "html", "declared", F.coalesce(held, F.lit(False)).alias("held")).mapInArrow(_cut, "page_id bigint, declared string, held boolean, segments array<string>")


def train(pages: DataFrame, text: str = "html") -> Model:
    """A model of the column ``text``."""
    return train_on(materialize(segmented(pages.select(F.lit(None).cast("bigint").alias("page_id"), F.col(text).alias("html"), F.lit(None).cast("string").alias("declared"))), "segments"))


def verdict(model: Model, distinct: list[str], margin: float, declared: str | None) -> tuple[bool, dict[str, str], tuple[str, float]]:
    """Whether text of a record's segments is lost, the repaired ones, and the best chain with its gain."""
    lost, fixes, total = False, {}, defaultdict(float)
    for s in distinct:
        lost |= "�" in s
        chain, gain = segment_chain(model, s, 0.5 * margin)
        if gain > 0.5 * margin:
            total[chain] += gain
            fixes[s] = repair(model, s, chain)
            lost |= "�" in fixes[s]
    first = ALIASES.get(declared or "", declared or "-") + ">"
    best = max(total.items(), key=lambda x: (x[1], x[0].startswith(first)), default=("", 0.0))
    return lost, fixes if best[1] > margin else {}, best


def judge(model: Model, page: str | None, margin: float = MARGIN, declared: str | None = None) -> tuple[bool, bool, str, float, str | None]:
    """(damaged, restorable, chain, gain, restored) of one record.

    ``restored`` is the record with each damaged segment decoded; replacement characters make it not
    restorable. Null, empty and pure ASCII records are undamaged.
    """
    if not page or (page.isascii() and "&" not in page):
        return False, False, "", 0.0, None
    found = list(spans(page))
    lost, fixes, best = verdict(model, list(dict.fromkeys(s for _, _, s in found)), margin, declared)
    if not lost and not fixes:
        return False, False, "", best[1], None
    parts, at = [], 0
    for begin, end, s in found if not lost else ():
        if s in fixes:
            parts += page[at:begin], escaped(page[begin:end], s, fixes[s])
            at = end
    return True, not lost, best[0] if fixes else "", best[1], None if lost else "".join(parts) + page[at:]


#: Python names of labels that headers use.
ALIASES = {"windows-1252": "cp1252", "iso-8859-1": "cp1252", "latin1": "cp1252", "windows-1251": "cp1251", "windows-1250": "cp1250", "iso-8859-2": "iso8859-2", "iso-8859-15": "iso8859-15"}


def _found(model, margin: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(model.value)
        for b in batches:
            bad = []
            for distinct, declared in zip(b.column("segments").to_pylist(), b.column("declared").to_pylist(), strict=True):
                lost, fixes, _ = verdict(m, distinct, margin, declared)
                bad.append(lost or bool(fixes))
            yield pa.RecordBatch.from_arrays([b.column("page_id").filter(pa.array(bad, pa.bool_()))], names=["page_id"])

    return run


def _restored(model, margin: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(model.value)
        for b in batches:
            ids, cols = [], ([], [], [], [])
            for key, page, declared in zip(b.column("page_id").to_pylist(), b.column("html").to_pylist(), b.column("declared").to_pylist(), strict=True):
                damaged, restorable, chain, gain, restored = judge(m, page, margin, declared)
                if damaged:
                    ids.append(key)
                    for c, v in zip(cols, (restorable, chain, gain, restored), strict=True):
                        c.append(v)
            out = [pa.array(ids, pa.int64()), *[pa.array(c, t) for c, t in zip(cols, (pa.bool_(), pa.string(), pa.float64(), pa.string()), strict=True)]]
            yield pa.RecordBatch.from_arrays(out, names=["page_id", "restorable", "chain", "gain", "restored"])

    return run


def damaged_pages(pages: DataFrame, with_text: bool = False) -> DataFrame:
    """Records of ``pages`` (page_id, html, headers) with wrongly decoded text.

    Columns page_id and, with ``with_text``, restorable, chain, gain and restored (null where the text is
    lost). A charset declared in the headers only decides between chains of equal gain. Null or empty
    html is undamaged; repeated rows are judged each on their own. The html is cut into segments once.
    """
    label = F.lower(F.regexp_extract(F.coalesce(F.try_element_at("headers", F.lit("content-type")), F.lit("")), r"(?i)charset\s*=\s*[\"']?([^\s;\"']+)", 1))
    labelled = pages.select("page_id", "html", label.alias("declared"))
    cut = materialize(segmented(labelled), "segments")
    model = pages.sparkSession.sparkContext.broadcast(train_on(cut.where("not held")).three)
    margin = validated_margin(cut.where("held"), model)
    if with_text:
        return labelled.mapInArrow(_restored(model, margin), "page_id bigint, restorable boolean, chain string, gain double, restored string")
    return cut.select("page_id", "declared", "segments").mapInArrow(_found(model, margin), "page_id bigint")
