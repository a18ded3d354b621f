"""Per-document text statistics and structural profiles: prose against lists, tables and junk.

A text is cut into runs of lines of one shape. Each run is described by distributions (word classes with
function words, character classes, sentence and line lengths, line ends and shapes), which are compared
with profiles through the Jensen-Shannon divergence; the nearest profile decides what a run is, its shape
is one of the distributions and settles nothing. The prose profile of each language and the structural
profiles are learned from runs of the corpus whose kind is certain.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.session import materialize

# Chosen lists: frequent function words by language.
FUNCTION_WORDS = {
    "en": "the a an of to in and is was for it on that with as be at by this are from or have has had not but which they we you he she its our their there can will would should if when while been more than no before after since".split(),
    "de": "der die das den dem des ein eine einen einem einer eines und ist war für auf mit zu zum zur von im in an am es nicht auch als aus bei nach vor wird wurde werden hat haben sich sie er wir ich oder aber noch wie so um bis seit ohne".split(),
    "fr": "le la les l un une des du de d et est en dans pour sur par au aux à que qui ne pas plus ce cette ces se s il elle nous vous ils a ont été être avec sans ou mais comme depuis après avant très".split(),
    "es": "el la los las un una unos unas de del y es en para por con a al que se no más su sus lo como pero o ya está fue son ha este esta estos hay muy sin sobre entre desde hasta cuando también".split(),
    "pt": "o a os as um uma uns umas de do da dos das e é em no na nos nas para por com ao à que se não mais seu sua como mas ou já está foi são tem este esta muito sem sobre entre desde até quando também".split(),
    "it": "il lo la i gli le un uno una di del della dei delle e è in per con su da al alla che si non più suo sua come ma o già sono ha questo questa molto senza".split(),
    "nl": "de het een en van in is op te dat die voor met zijn aan er niet ook als bij naar om uit door over maar of dan nog wel was worden heeft deze dit".split(),
    "pl": "i w na z do się nie to jest że o jak po od za ale dla czy tak przez już oraz przy ten ta te są był była".split(),
    "ru": "и в на с не что по к за из у от для это как но о так же он она они мы вы был была было уже или до при без".split(),
}
_SETS = {k: frozenset(v) for k, v in FUNCTION_WORDS.items()}
_NAMES = list(_SETS)
_LANGUAGES = {w: tuple(i for i, k in enumerate(_NAMES) if w in _SETS[k]) for v in _SETS.values() for w in v}

STRUCTURES = ("list", "table", "log", "code", "symbols", "encoded", "numbers", "keywords")
#: Words a sentence or an item needs to count as a full one.
FULL = 6
#: Share of characters outside sentences from which on a text is no prose.
LIMIT = 0.5

_MARK = re.compile(r"^\s*(?:[-–—*•·●▪◦‣○■□▶»+]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)])\s+(?=\S)")
_KEY = re.compile(r"^\s*[\"']?[\w .-]{1,30}[\"']?\s*[:=]\s*\S")
_STAMP = re.compile(r"^\s*\[?(?:\d{4}-\d\d-\d\d|\d{1,2}[/.]\w{2,3}[/.]\d{2,4}|\w{3} +\d{1,2} \d\d:\d\d|\d\d:\d\d:\d\d)|\b(?:DEBUG|INFO|WARN(?:ING)?|ERROR|TRACE|FATAL)\b.*\b\d")
_COLUMNS = re.compile(r"\S(?: {2,}|\t+)\S")
_END = re.compile(r"[.!?…。！？][\"'”’»)\]]*\s*$")
_UNIT = re.compile(r"(?<=[.!?…。！？])[\"'”’»)\]]*\s+|(?<=[。！？])")
_SIGNS_OF_CODE = re.compile(r"[{}=<>\\]|\w\(|\"\s*:")
_LETTER = re.compile(r"[^\W\d_]")
_SENTENCE_MARKS = frozenset(".,!?;:'\"()-–—’‘“”„«»…¿¡。、！？「」・")
_CJK = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\u0e00-\u0e7f]")


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of each character of the basic plane: letter, digit, space, sentence mark, other sign."""
    kinds = [0 if c.isalpha() else 1 if c.isdigit() else 2 if c.isspace() else 3 if c in _SENTENCE_MARKS else 4 for c in map(chr, range(1 << 16))]
    return np.array(kinds, np.uint8)


def char_counts(text: str) -> list[int]:
    """Numbers of letters, digits, spaces, sentence marks and other signs; rare planes count as the last."""
    if text.isascii():
        codes = np.frombuffer(text.encode("ascii"), np.uint8)
    else:
        codes = np.minimum(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32), 0xFFFF)
    return np.bincount(_classes()[codes], minlength=5).tolist()


def line_shape(line: str, counts: list[int] | None = None) -> str:
    """Shape of one line: blank, mark, table, pairs, log, code, symbols, encoded, numbers, names or plain."""
    s = line.strip()
    if not s:
        return "blank"
    n = len(s)
    _, digits, spaces, marks, others = counts or char_counts(s)
    signs = marks + others
    if digits >= 6 and _STAMP.search(s):
        return "log"
    if signs > 0.5 * n and signs > 3 and not _CJK.search(s):
        return "symbols"
    words = s.split()
    longest = max(map(len, words))
    if digits > 0.5 * (n - spaces) and n > 12:
        return "numbers"
    if len(words) <= 2 and "://" in s:
        return "table"
    if (longest >= 40 or (len(words) == 1 and n >= 24)) and s.isascii():
        return "code" if signs > 0.12 * n else "encoded"
    for cut in ("|", "\t", ";", " / ", " · ", " > ", " » "):
        if cut in s and (cells := s.count(cut)) >= 2 and len(words) <= 5 * (cells + 1):
            return "table" if cut in "|\t;" else "names"
    if ("  " in s or "\t" in s) and len(_COLUMNS.findall(s)) >= 2:
        return "table"
    if s[0] in "{}[]<" or (signs > 0.12 * n and _SIGNS_OF_CODE.search(s)):
        return "code"
    if _MARK.match(line):
        return "mark"
    if (m := _KEY.match(s)) and len(s[m.end() - 1 :].split()) <= 3 and not _END.search(s):
        return "pairs"
    return "plain"


@lru_cache(maxsize=200_000)
def _token(raw: str) -> tuple[int, int, tuple[str, ...], bool]:
    """(class apart from function words, weight, lower-case parts, has a letter) of one token.

    Classes: 1 lower-case word, 2 word with a capital, 3 number, 4 mixed, 5 signs, 6 punctuation.
    """
    core = raw.strip("".join(_SENTENCE_MARKS))
    if not core:
        return 6, 1, (), False
    letter = bool(_LETTER.search(core))
    if _CJK.search(core):
        return 1, max(1, len(core) // 4), (), letter
    parts = tuple(p for p in re.split(r"[’'-]", core.lower()) if p)
    if core.replace("-", "").replace("’", "").replace("'", "").isalpha():
        return (2 if core[0].isupper() else 1), 1, parts, letter
    if core.replace(".", "").replace(",", "").replace("%", "").isdigit():
        return 3, 1, (), letter
    return (4 if letter else 5), 1, (), letter


class Vocabulary(dict):
    """Numbers of the tokens seen, with what is known of each; grows as tokens are looked up."""

    def __init__(self) -> None:
        super().__init__()
        self.facts: list[tuple[int, int, bool, int]] = []
        self.votes: list[list[int]] = []

    def __missing__(self, raw: str) -> int:
        kind, weight, parts, letter = _token(raw)
        self.facts.append((kind, weight, letter, len(parts)))
        votes = [0] * len(_NAMES)
        for w in parts:
            for k in _LANGUAGES.get(w, ()):
                votes[k] += 1
        self.votes.append(votes)
        self[raw] = n = len(self)
        return n


SHAPES = ("plain", "mark", "pairs", "table", "log", "code", "symbols", "encoded", "numbers", "names")
_SHAPE_OF = {s: i for i, s in enumerate(SHAPES)}
#: Distributions of a run: name, size, weight in the sum of divergences. Where lines of a run stand and what
#: shape they have says less than what they are made of.
PARTS = (("word classes", 7, 1.0), ("characters", 5, 1.0), ("sentence words", 4, 1.0), ("sentence ends", 2, 1.0), ("line ends", 2, 0.5), ("line words", 4, 1.0), ("line shape", len(SHAPES), 0.5), ("number of lines", 3, 0.5), ("function words", 2, 1.0))
WIDTH = sum(n for _, n, _ in PARTS)
_WEIGHTS = np.repeat([w for _, _, w in PARTS], [n for _, n, _ in PARTS])


def _divided(counts: np.ndarray) -> np.ndarray:
    """Rows as distributions; an empty one is even."""
    total = counts.sum(axis=1, keepdims=True)
    return np.where(total > 0, counts / np.maximum(total, 1e-12), 1 / counts.shape[1])


def _cells(row: np.ndarray, cell: np.ndarray, shape: tuple[int, int], weight: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(row * shape[1] + cell, weights=weight, minlength=shape[0] * shape[1]).reshape(shape)


def line_counts(lines: list[str]) -> list[list[int]]:
    """``char_counts`` of many lines at once."""
    lengths = np.array([len(x) for x in lines], np.int64)
    codes = np.minimum(np.frombuffer("".join(lines).encode("utf-32-le", "replace"), np.uint32), 0xFFFF)
    return _cells(np.repeat(np.arange(len(lines)), lengths), _classes()[codes].astype(np.int64), (len(lines), 5)).astype(int).tolist()


def runs(text: str, counts: list[list[int]] | None = None) -> list[tuple[str, list[str], int, list[int]]]:
    """(shape, lines, characters, their classes) of neighbouring lines of one shape; blank lines end plain runs."""
    out: list[tuple[str, list[str], int, list[int]]] = []
    last = "blank"
    lines = text.splitlines()
    for line, c in zip(lines, counts or line_counts([x.strip() for x in lines]), strict=True):
        shape = line_shape(line, c)
        if shape == "blank":
            if out:
                out[-1] = (*out[-1][:2], out[-1][2] + len(line) + 1, out[-1][3])
        elif out and out[-1][0] == shape and (last == shape or shape != "plain"):
            before = out[-1]
            before[1].append(line)
            out[-1] = (shape, before[1], before[2] + len(line) + 1, [x + y for x, y in zip(before[3], c, strict=True)])
        else:
            out.append((shape, [line], len(line) + 1, c))
        last = shape
    return out


def certain(shape: str, lines: int, ended: int, ends: bool, language: str, share: float, words: int, units: int) -> str | None:
    """Kind of a run that is beyond doubt, else None."""
    mean = words / units if units else 0
    if shape == "plain":
        if words >= 12 and share >= 0.25 and mean >= FULL and (ends or words >= FULL * lines):
            return "prose-" + (language if ends else "unended")
        if lines >= 4 and words <= 4 * lines and not ended:
            return "list-unmarked"
        return "keywords" if words >= 12 and share < 0.02 and not ends else None
    if shape in ("mark", "pairs"):
        return "list" if lines >= 3 and mean <= 4 else None
    if shape == "names":
        return "keywords"
    return shape if shape in STRUCTURES else None


class Described:
    """Runs of many texts: number of their text, characters, language, certain kind and distributions."""

    def __init__(self, texts: list[str | None], vocabulary: Vocabulary | None = None):
        vocabulary = Vocabulary() if vocabulary is None else vocabulary
        split = [t.splitlines() if t and t.strip() else [] for t in texts]
        counts = line_counts([x.strip() for lines in split for x in lines])
        found, at = [], 0
        for i, (t, lines) in enumerate(zip(texts, split, strict=True)):
            if lines:
                found += [(i, *r) for r in runs(t, counts[at : at + len(lines)])]
            at += len(lines)
        n = len(found)
        codes: list[int] = []
        unit_ends, unit_run, unit_stops, signs, tops = [], [], [], [], []
        ends, rows_of_lines, words_of_lines, size_of = np.zeros((n, 2)), [], [], vocabulary.__getitem__
        for r, (_, shape, lines, _, _) in enumerate(found):
            if shape == "mark":
                lines = [_MARK.sub("", x) for x in lines]
            whole = " ".join(lines)
            cjk = not whole.isascii() and _CJK.search(whole) is not None
            tops.append(whole.isupper())
            for x in lines:
                ends[r, 0 if _END.search(x) else 1] += 1
                rows_of_lines.append(r)
                words_of_lines.append(len(x.split()))
            for u in _UNIT.split(whole) if shape == "plain" else (u for x in lines for u in _UNIT.split(x)):
                if u and (tokens := u.split()):
                    codes += map(size_of, tokens)
                    unit_ends.append(len(codes))
                    unit_run.append(r)
                    unit_stops.append(0 if _END.search(u) else 1)
                    signs.append(len(_CJK.findall(u)) if cjk else 0)
        self.text = np.array([f[0] for f in found], np.int64)
        self.size = np.array([f[3] for f in found], np.int64)
        shape = np.array([_SHAPE_OF[f[1]] for f in found], np.int64)
        c, unit_run, signs = np.array(codes, np.int64), np.array(unit_run, np.int64), np.array(signs, np.int64)
        unit = np.repeat(np.arange(len(unit_run)), np.diff(np.r_[0, np.array(unit_ends, np.int64)]))
        run = unit_run[unit] if len(unit) else np.zeros(0, np.int64)
        facts = np.array(vocabulary.facts or [(0, 0, False, 0)], np.int64)
        votes = np.array(vocabulary.votes or [[0] * len(_NAMES)], np.int64)
        given = np.stack([np.bincount(run, weights=votes[c, k], minlength=n) for k in range(len(_NAMES))], axis=1) if n else np.zeros((0, len(_NAMES)))
        parts = np.bincount(run, weights=facts[c, 3], minlength=n)
        self.language = given.argmax(axis=1)
        self.share = np.divide(given.max(axis=1, initial=0), parts, out=np.zeros(n), where=parts > 0)
        known = votes[c, self.language[run]] > 0
        kind = np.where((facts[c, 0] == 2) & np.array(tops, bool)[run], 1, facts[c, 0]) if n else facts[c, 0]
        classes = _cells(run, np.where(known, 0, kind), (n, 7), np.where(known, 1, facts[c, 1]))
        words = np.bincount(unit, weights=facts[c, 2], minlength=len(unit_run)) if len(unit_run) else np.zeros(0)
        words = np.where(signs > 4, signs // 2, words)
        sentences = _cells(unit_run, np.digitize(words, (3, FULL, 12)), (n, 4), words)
        self.words, units = sentences.sum(axis=1), np.bincount(unit_run, minlength=n)
        sentences[self.words == 0, 0] = 1
        length = np.array(words_of_lines, np.int64)
        stops = _cells(unit_run, np.array(unit_stops, np.int64), (n, 2), np.diff(np.r_[0, np.array(unit_ends, np.int64)]))
        line_words = _cells(np.array(rows_of_lines, np.int64), np.digitize(length, (3, 5, 8)), (n, 4), length)
        lines = ends.sum(axis=1)
        one = lambda at, k: np.eye(k)[at]
        self.vectors = np.concatenate([_divided(classes), _divided(np.array([f[4] for f in found], float).reshape(n, 5)), _divided(sentences), _divided(stops), _divided(ends), _divided(line_words), one(shape, len(SHAPES)), one(np.digitize(lines, (2, 4)), 3), np.stack([self.share, 1 - self.share], axis=1)], axis=1) if n else np.zeros((0, WIDTH))
        last = [bool(_END.search(f[2][-1])) for f in found]
        self.kind = [certain(f[1], int(k), int(m), e, _NAMES[g], s, int(w), int(u)) for f, k, m, e, g, s, w, u in zip(found, lines, ends[:, 0], last, self.language, self.share, self.words, units, strict=True)]


def divergences(p: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Sum of the Jensen-Shannon divergences (in bits, weighted) of the distributions of each row of ``p`` to each of ``many``."""
    p = np.atleast_2d(np.asarray(p, float))
    out = np.zeros((len(p), len(many)))
    with np.errstate(divide="ignore", invalid="ignore"):
        for j, q in enumerate(np.asarray(many, float)):
            m = (p + q) / 2
            out[:, j] = 0.5 * ((np.where(p > 0, p * np.log2(p / m), 0.0) + np.where(q > 0, q * np.log2(q / m), 0.0)) @ _WEIGHTS)
    return out


class Profiles:
    """Profiles as one matrix, in order of their names."""

    def __init__(self, known: dict[str, list[float]]):
        self.names = sorted(known)
        self.matrix = np.array([known[k] for k in self.names])
        self.prose = np.array([k.startswith("prose-") for k in self.names])

    def judge(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest profile of each run, and its divergence from the nearest prose."""
        d = divergences(vectors, self.matrix)
        return d.argmin(axis=1), d[:, self.prose].min(axis=1, initial=np.inf)


#: Texts whose profiles serve where the corpus has no certain run of a kind.
SAMPLES = {
    "prose-en": "The report on the new pages was late again, so the team had to wait for a while. It is not clear who will look after it from now on.",
    "prose-de": "Der Bericht über die neuen Seiten kam wieder zu spät, und das Team musste eine Weile warten. Es ist nicht klar, wer sich darum kümmern wird.",
    "prose-fr": "Le rapport sur les nouvelles pages est encore arrivé en retard et l'équipe a dû attendre. On ne sait pas qui va s'occuper de la suite avec eux.",
    "prose-es": "El informe de las nuevas páginas llegó otra vez tarde y el equipo tuvo que esperar. No está claro quién se va a ocupar de ello desde ahora.",
    "prose-pt": "O relatório das novas páginas chegou mais uma vez tarde e a equipa teve de esperar. Não é claro quem vai tratar do assunto com os outros.",
    "prose-it": "Il rapporto sulle nuove pagine è arrivato di nuovo in ritardo e la squadra ha dovuto aspettare. Non si sa chi se ne occuperà da ora in poi.",
    "prose-nl": "Het verslag over de nieuwe pagina's kwam weer te laat en het team moest een tijd wachten. Het is niet duidelijk wie er nu voor zal zorgen.",
    "prose-pl": "Raport o nowych stronach przyszedł znowu za późno i zespół musiał na niego czekać. Nie jest jasne, kto się tym teraz zajmie przez resztę roku.",
    "prose-ru": "Отчёт о новых страницах снова пришёл поздно, и команде пришлось на это ждать. Не ясно, кто теперь будет за это отвечать до конца года.",
    "prose-other": "Rapporten kom återigen sent, medan gruppen väntade länge utanför kontoret. Ingen visste säkert, vem framöver ansvarade.\nYeni sayfaların raporu yine geç geldi, ekip uzun süre bekledi. Kimse bundan sonra kimin ilgileneceğini bilmiyor.",
    "prose-unended": "a report on the new pages was late again so that the team had to wait\nfor it and it is not clear who will look after it from now on",
    "prose-unspaced": "新しいページの報告はまた遅れて届き、担当者は長い間待つことになりました。今後だれが世話をするのかは、まだはっきりしていません。",
    "list": "- new pages\n- old pages\n- Red lamps\n- broken links\n- Home\n- Shop\n- price 20",
    "list-unmarked": "the home page\nred lamps\nbroken links\nthe old shop\nour prices\nnew\na blue door",
    "table": "page | score | state\n/home | 96 | ok\n/shop | 71 | slow\n/news | 18 | gone\nhttps://a.example/x\t200\t1.5",
    "log": "2024-10-28T05:28:12 INFO [fetch] GET /home 200 18642\n2024-10-28T05:28:14 WARN [fetch] GET /shop 503 112\n2024-10-28T05:28:19 INFO done in 7 s",
    "code": "var a = function(x) { return y[1] || !0; };\nif (a(b) === null) { c.push({id: 1}); }\n<div class=\"x\"><b>{{ y }}</b></div>",
    "symbols": "|$$%%&|{{;;^\n[[&&<<(]\\ !/~@@>> -- ==\n+++ *** ### ???",
    "encoded": "kNykBJVrv7rFhR8mQzTzqyef18jffE5Mk7nJdEUEmpmQbPbFWjwfMM6QaQXQGUvO5pGLfh\nQmFzZTY0IGlzIG5vdCBwcm9zZSBhdCBhbGwsIGp1c3QgYnl0ZXM=aGVsbG8gd29ybGQh",
    "numbers": "12 345 6789 1234 5678 90 1 23 456 7890 12 345\n6789 1234 5678 90 1 23",
    "keywords": "red lamps, garden studio, river events, north books, meadow hotel, harbor cycles, brook gallery, cheap flights, hotel offers, best price, buy online",
}


def train(described: DataFrame) -> dict[str, list[float]]:
    """Mean distributions of all certain runs, by kind; every task sends one row per kind."""
    sums = described.select("runs").mapInArrow(_seeds, "kind string, n bigint, v array<double>")
    flat = sums.select("kind", "n", F.posexplode("v").alias("i", "x")).groupBy("kind", "i").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).where("n > 0").collect()
    found: dict[str, list[float]] = defaultdict(lambda: [0.0] * WIDTH)
    for r in flat:
        found[r["kind"]][r["i"]] = r["x"] / r["n"]
    return {**FALLBACK, **found}


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(WIDTH))
    count: dict[str, int] = defaultdict(int)
    for b in batches:
        flat = pc.list_flatten(b.column(0))
        kinds = pc.struct_field(flat, "kind")
        vectors = pc.list_flatten(pc.struct_field(flat, "vector")).to_numpy(zero_copy_only=False).reshape(-1, WIDTH)
        coded = kinds.dictionary_encode()
        at = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        for i, k in enumerate(coded.dictionary.to_pylist()):
            total[k] += vectors[at == i].sum(axis=0)
            count[k] += int((at == i).sum())
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([count[k] for k in total], pa.int64()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], names=["kind", "n", "v"])


RUN = pa.struct([("size", pa.int64()), ("lang", pa.string()), ("kind", pa.string()), ("vector", pa.list_(pa.float32()))])
RUN_DDL = "array<struct<size:bigint,lang:string,kind:string,vector:array<float>>>"


def _lists(d: Described, texts: int) -> pa.Array:
    """The runs of each text as Arrow lists."""
    flat = pa.ListArray.from_arrays(pa.array(np.arange(0, len(d.text) * WIDTH + 1, WIDTH, dtype=np.int32)), pa.array(d.vectors.astype(np.float32).ravel()))
    run = pa.StructArray.from_arrays([pa.array(d.size), pa.array(np.array(_NAMES)[d.language].tolist(), pa.string()), pa.array(d.kind, pa.string()), flat], fields=list(RUN))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(d.text, np.arange(texts + 1)).astype(np.int32)), run)


def _described(with_basics: bool):
    """Counts and runs of each text: texts are read once, profiles are learned and applied on these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary()
        for b in batches:
            texts = b.column(1).to_pylist()
            if len(vocabulary) > 500_000:
                vocabulary = Vocabulary()
            d = Described(texts, vocabulary)
            cols = []
            if with_basics:
                at = np.searchsorted(d.text, np.arange(len(texts) + 1))
                counts = [basics(t, d.language[i:j], d.size[i:j]) for t, i, j in zip(texts, at[:-1], at[1:], strict=True)]
                cols = [pa.array(list(c), t) for c, t in zip(zip(*counts, strict=True), BASIC_TYPES, strict=True)] if counts else [pa.array([], t) for t in BASIC_TYPES]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, _lists(d, len(texts))], names=["doc_id", *(BASICS if with_basics else ()), "runs"])

    return run


FIELDS = "n_words bigint, mean_word_length double, symbol_ratio double, punctuated_lines double, common_words double, language string, profile string, divergence double, outside_share double"


BASICS = ("n_words", "mean_word_length", "symbol_ratio", "punctuated_lines", "common_words", "language")
BASIC_TYPES = (pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.string())


def basics(text: str | None, languages: np.ndarray, sizes: np.ndarray) -> tuple:
    """Values of ``BASICS``, given the runs. Null and blank texts have no words and nulls for the rest."""
    if not len(sizes):
        return (0, None, None, None, None, None)
    weight = np.bincount(languages, weights=sizes, minlength=len(_NAMES))
    lang = max(_NAMES, key=lambda k: (weight[_NAMES.index(k)], k))
    words = re.findall(r"[^\W\d_]+", text)
    lines = [x for x in text.splitlines() if x.strip()]
    letters = sum(map(len, words))
    _, digits, spaces, _, _ = char_counts(text)
    visible = len(text) - spaces
    signs = visible - letters - digits
    return (
        len(words),
        letters / len(words) if words else None,
        signs / visible if visible else None,
        sum(bool(_END.search(x)) for x in lines) / len(lines),
        sum(w.lower() in _SETS[lang] for w in words) / len(words) if words else None,
        lang,
    )


def structure(profiles: Profiles, text: np.ndarray, sizes: np.ndarray, vectors: np.ndarray, texts: int) -> tuple[list, list, np.ndarray]:
    """(profile, divergence from prose, share of characters outside sentences) of texts, given their runs."""
    near, to_prose = profiles.judge(vectors)
    total = np.bincount(text, weights=sizes, minlength=texts)
    by_profile = _cells(text, near, (texts, len(profiles.names)), sizes)
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = np.bincount(text, weights=sizes * to_prose, minlength=texts) / total
        outside = by_profile[:, ~profiles.prose].sum(axis=1) / total
    most = by_profile.shape[1] - 1 - by_profile[:, ::-1].argmax(axis=1) if texts else []
    has = total > 0
    return [profiles.names[k] if h else None for k, h in zip(most, has, strict=True)], [float(x) if h else None for x, h in zip(mean, has, strict=True)], outside


def statistics(profiles: Profiles, text: str | None) -> tuple:
    """Values of ``FIELDS`` of one text. Null and blank texts have no words, profile or share."""
    d = Described([text])
    profile, dist, outside = structure(profiles, d.text, d.size, d.vectors, 1)
    return (*basics(text, d.language, d.size), profile[0], dist[0], float(outside[0]) if profile[0] else None)


def _scored(profiles, found_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Profiles(profiles.value)
        for b in batches:
            held = b.column("runs")
            flat = pc.list_flatten(held)
            vectors = pc.list_flatten(pc.struct_field(flat, "vector")).to_numpy(zero_copy_only=False).reshape(-1, WIDTH)
            text = pc.list_parent_indices(held).to_numpy(zero_copy_only=False)
            profile, dist, outside = structure(known, text, pc.struct_field(flat, "size").to_numpy(zero_copy_only=False), vectors, b.num_rows)
            if found_only:
                yield pa.RecordBatch.from_arrays([b.column("doc_id").filter(pa.array(np.nan_to_num(outside) > LIMIT))], names=["doc_id"])
            else:
                new = [pa.array(profile, pa.string()), pa.array(dist, pa.float64()), pa.array([float(x) if p else None for x, p in zip(outside, profile, strict=True)], pa.float64())]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[b.column(c) for c in BASICS], *new], names=["doc_id", *BASICS, "profile", "divergence", "outside_share"])

    return run


def text_statistics(docs: DataFrame, found_only: bool = False) -> DataFrame:
    """Statistics of every row of ``docs`` (doc_id, text), or only the ids of texts that are no prose.

    Texts are read once; what describes their runs is written out, and the profiles are learned from it
    and compared with it. Repeated rows are judged alike, each with a row of its own.
    """
    basic = "" if found_only else ", " + ", ".join(f"{n} {t}" for n, t in zip(BASICS, ("bigint", "double", "double", "double", "double", "string"), strict=True))
    described = materialize(docs.select("doc_id", "text").mapInArrow(_described(not found_only), f"doc_id bigint{basic}, runs {RUN_DDL}"), "runs")
    profiles = docs.sparkSession.sparkContext.broadcast(train(described))
    return described.mapInArrow(_scored(profiles, found_only), "doc_id bigint" + ("" if found_only else ", " + FIELDS))


def _fallback() -> dict[str, list[float]]:
    d = Described(list(SAMPLES.values()))
    return {k: np.average(d.vectors[d.text == i], axis=0, weights=d.size[d.text == i]).tolist() for i, k in enumerate(SAMPLES)}


#: Profiles of the samples.
FALLBACK = _fallback()
