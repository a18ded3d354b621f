"""Template residue, filler, error pages and calls for scripts in place of content.

Captures are cut into units: sentences of their blocks, and placeholder tokens. Few units, the seeds, are
residue for certain and carry trusted labels. Labels spread through connected components: from unit to
near-duplicate unit (partitioned SimHash tables, one per pair of fingerprint blocks, then Hamming
distance and shared shingles; a search by rarest shingles adds the pairs that differ in more bits), and
from captures that say nothing but a message to what else they say. Last, a capture is judged by the
labels of its units and by what real text stands beside them.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.session import BROADCAST_ROWS, broadcast_if_small, materialize

#: SimHash search: fingerprints differ in at most so many of 64 bits.
HAMMING = 5
#: Fingerprint blocks (bits each); with HAMMING = 5 at least two of seven agree, hence 21 tables.
BLOCKS = (9, 9, 9, 9, 9, 9, 10)
TABLES = len(BLOCKS) * (len(BLOCKS) - 1) // 2
#: Least share of common character shingles, and their length.
SIMILAR, SHINGLE = 0.8, 4
#: Buckets in which shingles are counted, which puts them in order from rare to frequent.
BUCKETS = 1 << 18
#: A sentence of so many words that is no residue is real content (or so many characters without spaces).
REAL_WORDS, REAL_CHARS = 5, 10
#: A sentence of so many characters is real, too, however few spaces it has.
LONG_CHARS = 20
#: A word belongs to filler if it is so much more frequent there, and so often; share of such words that
#: makes a sentence filler.
FILLER_RATIO, FILLER_COUNT, FILLER_SHARE = 5.0, 3, 0.6

# Chosen patterns: placeholder tokens of template languages and mail-merge systems.
TOKENS = (
    r"\{\{[^{}\n]+\}\}",
    r"\{%[^{}\n]+%\}",
    r"<%[=-]?[^<>\n]+%>",
    r"<\?(?:=|php)[^<>\n]+\?>",
    r"[$#]\{[^{}\n]+\}",
    r"%%[A-Za-z][\w .-]*%%",
    r"(?<![\w%])%[A-Za-z]+(?:_[A-Za-z]+)+%(?![\w%])",
    r"\[\[[+*$~]?[A-Za-z][\w .-]*\]\]",
    r"\[%[^\[\]\n]+%\]",
    r"\$\$[A-Za-z]\w*\$\$",
    r"@@[A-Za-z]\w*@@",
    r"(?<!\w)__[A-Za-z]\w*?__(?!\w)",
    r"<<\s*[A-Za-z][\w .]*>>",
    r"\*\|[A-Za-z][\w:]*\|\*",
    r"(?<!\w)~[A-Z][A-Z_]{2,}~(?!\w)",
    r"(?<![\w{$#])\{[A-Z][A-Z_]{2,}\}(?!\})",
    r"(?i:\[(?:insert|enter|add|your|type|replace)\b[^\[\]\n]+\])",
    r"(?i:<(?:insert|enter|add|your|type)\s[^<>\n]+>)",
    r"\[[A-Z][\w’']*(?: [\w’']+){1,4}\]",
    r"\[(?:Town|City|Name|Date|Price|Phone|Address|Company|Title|Street|Country|Email|Author|Brand|Category|Headline|Label|Product|Site|Slogan|State|Subtitle|Summary|Tagline)\]",
    r"(?i:<[a-z]+ [a-z_]+ here>)",
    r"\[object Object\]",
)
_TOKEN = re.compile("|".join(TOKENS))
_SLOTS_ONLY = re.compile(r"^\W*(?:\{\d\}\W*)+$")
_LIKELY = re.compile(r"[{}\[\]%$@~_|<#]")

# Chosen patterns: notes to the author that should have been replaced (whole sentences, in lower case).
NOTES = (
    r"\[?(?:put |write |type |enter )?your (?:\w+ ){1,3}(?:goes |comes )?here\]?",
    r"(?:click|tap) here to (?:edit|add|change)\b.*",
    r"(?:add|enter|insert|type|put) (?:your|a|the|some) (?:\w+ ){0,3}(?:description|summary|text|title|headline|tagline|name|content|image|logo)\b.*",
    r"(?:replace|change|edit) (?:this|the sample|the default) (?:text|title|heading|paragraph|sentence|copy)\b.*",
    r"insert (?:headline|title|text|copy|image|name|logo|subtitle)\b.*",
    r"(?:todo|tbd|fixme)\b.*",
    r"(?:section |page )?(?:heading|title|headline|text|image|content) placeholder",
    r"(?:votre|ton|ajoutez votre|saisissez votre) (?:texte|titre|nom|slogan)(?: ici)?",
    r"(?:escriba|escribe|introduzca|inserte|añada) (?:aquí )?(?:su|tu|el|un) (?:texto|título|nombre)(?: aquí)?",
    r"(?:hier )?(?:ihren |den )?(?:text|titel|überschrift|namen) (?:hier )?(?:einfügen|eingeben|eintragen)",
    r"(?:insira|escreva|digite) (?:aqui )?(?:o )?(?:seu )?(?:texto|título|nome)(?: aqui)?",
    r"(?:wpisz|wstaw) (?:tutaj )?(?:swój |tu )?(?:tekst|tytuł)(?: tutaj)?",
    r"(?:введите|вставьте) (?:свой |ваш )?(?:текст|заголовок)(?: здесь)?",
    r"ここに(?:テキスト|文章|タイトル|見出し)を?.{0,8}",
)
# Seeds: few general messages; what else such captures say is learned from them (``learn``, ``Near``).
SCRIPTS = (
    r"(?=.*\b(?:java ?script|scripts?|scripting)\b)(?=.*(?:enable|activ|aktivier|habilit|attiva|schakel|włącz|включ|turn|switch|requires?|needs?|disabled|allowed|blocked|\brun\b)).*",
    r"(?=.*javascript)(?=.*(?:有効|启用|활성화)).*",
    r"(?:checking|verifying) (?:if )?your browser.*",
)
ERRORS = (
    # Reason phrases of HTTP (fixed values), alone or after their number.
    r"(?:error |http error )?(?:0 )?(?:bad request|unauthorized|payment required|forbidden|not found|method not allowed|not acceptable|request timeout|conflict|gone|too many requests|internal server error|not implemented|bad gateway|service (?:temporarily )?unavailable|gateway time-?out)",
    r"(?:page not found|page introuvable|seite nicht gefunden|página no encontrada|página não encontrada|страница не найдена|nie znaleziono strony|pagina non trovata|ページが見つかりません)",
    r"(?:this |the |we |sorry)[^“”\"«»]*\b(?:page|file|address|url|resource)\b[^“”\"«»]*\b(?:not found|not exist|no longer|was deleted)\b[^“”\"«»]*|.*\b(?:no|not have|don.t have) permission to (?:see|view|access|open)\b.*",
    r"error|warning|oops|ouch",
    r"(?:an? (?:unexpected |internal )?error (?:has )?occurred|something went wrong|access denied|unhandled exception|error establishing a database connection)\b.*",
    r"(?:session|account|site|service) (?:expired|suspended|offline|unavailable)",
)
FILLERS = (
    r"lorem ipsum\b.*",
    r"(?:this is )?(?:a )?(?:sample|dummy|placeholder|filler) (?:text|content)\b.*",
    r"(\w+) (?:\1,? ?){2,}",
)

_LABELS = [(name, tuple(re.compile(rf"(?:{p})\W*$", re.S) for p in pats)) for name, pats in (("note", NOTES), ("filler", FILLERS), ("script", SCRIPTS), ("error", ERRORS))]
#: Keyboard noise makes a sentence of its own, which is filler.
NOISE = ("asdf", "qwerty", "jkl", "xxx")
_NOISE = re.compile(rf"((?:(?<!\w)(?:{'|'.join(NOISE)}+)(?!\w)[ ,]*){{2,}})")
#: Seeds are short: longer sentences talk about such things. Learned messages may have any length.
LONGEST = 16

_DROP = re.compile(r"<!--.*?-->|<(script|style|pre|code|template)\b.*?</\1\s*>", re.S | re.I)
_NOSCRIPT = re.compile(r"<noscript\b[^>]*>(.*?)</noscript\s*>", re.S | re.I)
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.S | re.I)
_META = re.compile(r"<meta\b[^>]*>", re.I)
_IS_DESCRIPTION = re.compile(r"\bname\s*=\s*[\"']?description\b", re.I)
_CONTENT = re.compile(r"\bcontent\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", re.I)
_HEAD = re.compile(r"<head\b.*?</head\s*>", re.S | re.I)
_PLAIN_TAG = r"(?:a|abbr|address|article|aside|audio|b|base|bdi|bdo|big|blockquote|body|br|button|canvas|caption|center|cite|col|colgroup|dd|del|details|dfn|dialog|div|dl|dt|em|embed|fieldset|figcaption|figure|font|footer|form|frame|frameset|h[1-6]|head|header|hr|html|i|iframe|img|input|ins|label|legend|li|link|main|map|mark|menu|meta|meter|nav|object|ol|optgroup|option|output|p|param|picture|progress|q|rp|rt|ruby|s|section|select|small|source|span|strike|strong|sub|summary|sup|table|tbody|td|tfoot|th|thead|time|title|tr|track|tt|u|ul|var|video|wbr)"
_TAG = re.compile(rf"(</?{_PLAIN_TAG}(?=[\s/>])[^<>]*>|<![^<>]*>)", re.I)
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9]*)")
_INLINE = frozenset("a abbr b bdi bdo big cite del dfn em font i img ins label mark q s small span strike strong sub sup time tt u var wbr".split())
_ASIDE = frozenset("nav footer header aside button select option form".split())
_NAV_LIST = re.compile(r"<ul\b[^>]*\b(?:class|id|role)\s*=\s*[\"'][^\"']*\b(?:nav|navigation|menu|breadcrumbs?)\b", re.I)
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”’»)]*\s+(?=\S)|(?<=[。！？])")
_ALPHA_WORD = re.compile(r"\S*[^\W\d_]\S*")
_UNSPACED = re.compile(r"[\u3040-\u9fff\uac00-\ud7af]")
_DIGITS = re.compile(r"\d+")


def blocks(page: str) -> list[tuple[str, str]]:
    """(role, text) of the title, the description and each block: title, meta, head, body, side or noscript."""
    page = _DROP.sub(" ", page)
    out = [("title", html.unescape(m)) for m in _TITLE.findall(page)[:1]]
    for m in _META.findall(page):
        if _IS_DESCRIPTION.search(m) and (c := _CONTENT.search(m)):
            out.append(("meta", html.unescape(c.group(1) or c.group(2) or "")))
            break
    out += [("noscript", html.unescape(_TAG.sub(" ", m))) for m in _NOSCRIPT.findall(page)]
    body = _HEAD.sub(" ", _NOSCRIPT.sub(" ", _TITLE.sub(" ", page)))
    text: list[str] = []
    aside, lists, heading = 0, [], 0

    def flush() -> None:
        joined = html.unescape("".join(text)).strip()
        text.clear()
        if joined:
            out.append(("side" if aside or any(lists) else "head" if heading else "body", joined))

    for i, piece in enumerate(_TAG.split(body)):
        if not i % 2:
            if piece:
                text.append(piece)
            continue
        if not (n := _NAME.match(piece)):
            continue
        name, closing = n.group(1).lower(), piece[1] == "/"
        if name in _INLINE:
            continue
        flush()
        if name in _ASIDE:
            aside = max(0, aside + (-1 if closing else 1))
        elif name == "ul":
            if not closing:
                lists.append(bool(_NAV_LIST.match(piece)))
            elif lists:
                lists.pop()
        elif len(name) == 2 and name[0] == "h" and name[1].isdigit():
            heading = 0 if closing else 1
    flush()
    return out


def normal(sentence: str) -> str:
    """Lower case, digits as one 0, single spaces."""
    return _DIGITS.sub("0", " ".join(sentence.split())).casefold()


def trusted_label(text: str) -> str | None:
    """Label of a normalised sentence that certainly is residue: a seed of the search."""
    core = text.strip(" .!?…。:;,\"'“”«»()")
    if _NOISE.fullmatch(core):
        return "filler"
    if text.count(" ") >= LONGEST:
        return "filler" if text.startswith("lorem ipsum") else None
    for name, patterns in _LABELS:
        if any(p.match(core) for p in patterns):
            return name
    return None


@lru_cache(maxsize=300_000)
def unit(text: str) -> tuple[int, str | None, int, int]:
    """(id, trusted label, words that count as real, words) of a normalised sentence; two characters stand for a word where no spaces do."""
    words, size = len(_ALPHA_WORD.findall(text)), text.count(" ") + 1
    if _UNSPACED.search(text):
        words, size = REAL_WORDS if len(text) >= REAL_CHARS else 0, max(size, len(text) // 2)
    elif len(text) >= LONG_CHARS:
        words = max(words, REAL_WORDS)
    return _id(text), trusted_label(text), words if words >= REAL_WORDS else 0, size


def _id(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text) - 2**63


def units(page: str | None) -> list[tuple[str, str]]:
    """(role, normalised text) of each unit of a capture; placeholder tokens have the role token."""
    out = []
    for role, text in blocks(page) if page else ():
        if role != "noscript" and _LIKELY.search(text):
            out += [("token", _DIGITS.sub("0", t)) for t in _TOKEN.findall(text)]
            if _SLOTS_ONLY.match(text):
                out.append(("token", text))
        for s in _SENTENCE.split(text):
            if s and (n := normal(s)):
                out += [(role, t) for p in _NOISE.split(n) if (t := p.strip())] if (NOISE[0] in n or NOISE[1] in n or NOISE[2] in n or NOISE[3] in n) and _NOISE.search(n) else [(role, n)]
    return out


# --- fingerprints ------------------------------------------------------------------------------


def _hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each character shingle of each text (repeated ones too), and the number of its text."""
    padded = [f" {t} ".ljust(SHINGLE) for t in texts]
    codes = np.frombuffer("".join(padded).encode("utf-32-le"), np.uint32).astype(np.uint64)
    lengths = np.array([len(p) for p in padded])
    ends = np.cumsum(lengths)
    h = np.zeros(len(codes) - SHINGLE + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(SHINGLE):
            h = h * np.uint64(0x100000001B3) + codes[j : len(codes) - SHINGLE + 1 + j]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
    starts = ends - lengths
    inside = np.ones(len(h), bool)
    for j in range(1, SHINGLE):  # shingles across two texts
        cut = ends[:-1] - j
        inside[cut[cut < len(h)]] = False
    text_of = np.repeat(np.arange(len(texts)), lengths)[: len(h)]
    return h[inside], text_of[inside]


def fingerprints(texts: list[str]) -> np.ndarray:
    """SimHash over character shingles of each text, all at once."""
    if not texts:
        return np.zeros(0, np.int64)
    h, text_of = _hashes(texts)
    first = np.searchsorted(text_of, np.arange(len(texts)))
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    votes = 2 * ones > np.diff(np.r_[first, len(h)])[:, None]
    return np.packbits(votes, axis=1, bitorder="little").view("<u8")[:, 0].astype(np.uint64).view(np.int64)


def prefixes(texts: list[str], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rarest distinct shingles of each text from the rarest on, how many those are, and how many it has.

    Two texts with n and m shingles whose similarity is ``SIMILAR`` share ``SIMILAR`` max(n, m) of them, so
    in any common order one of the first n - ceil(``SIMILAR`` n) + 1 is one of the other's first ones.
    """
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, text_of = _hashes(texts)
    order = np.lexsort((h, counts[h % np.uint64(BUCKETS)], text_of))
    h, text_of = h[order], text_of[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (text_of[1:] != text_of[:-1])]
    h, text_of = h[new], text_of[new]
    sizes = np.bincount(text_of, minlength=len(texts))
    last = sizes - np.ceil(SIMILAR * sizes - 1e-9).astype(np.int64)
    keep = np.arange(len(h)) - (np.cumsum(sizes) - sizes)[text_of] <= last[text_of]
    return h[keep].view(np.int64), last + 1, sizes


def shingles(text: str) -> set[str]:
    t = f" {text} "
    return {t[i : i + SHINGLE] for i in range(max(1, len(t) - SHINGLE + 1))}


def similarity(a: str, b: str) -> float:
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


# --- distributed stages ------------------------------------------------------------------------

#: Distinct units that a task remembers, so that each text is sent once per task, or nearly so.
REMEMBERED = 300_000
#: Where a unit stands in a capture, as bits.
ROLES = {"title": 1, "meta": 2, "noscript": 4, "head": 8, "body": 16, "side": 32, "token": 64}
MAIN, SAYS = ROLES["noscript"] | ROLES["head"] | ROLES["body"], ROLES["noscript"] | ROLES["body"]
UNIT_SCHEMA = "page_id bigint, site string, roles int, unit bigint, words int, size int, page_units int, page_size int, page_real int, text string, label string"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per capture and unit, with what the capture has of units and words in its main part."""
    sent: set[int] = set()
    for b in batches:
        rows = []
        for page_id, site, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            held: dict[int, list] = {}
            for role, text in units(page):
                if role == "token":
                    text = f"token: {text}"  # a unit of its own beside a sentence of that text
                key, label, n, size = (_id(text), "token", 0, 0) if role == "token" else unit(text)
                if key in held:
                    held[key][0] |= ROLES[role]
                else:
                    held[key] = [ROLES[role], n, size, None if key in sent else text, label]
                    sent.add(key)
            main = [h for h in held.values() if h[0] & MAIN]
            whole = len(main), sum(h[2] for h in main), sum(h[1] for h in main if h[0] & ROLES["body"])
            rows += [(page_id, site, roles, key, n, size, *whole, text, label) for key, (roles, n, size, text, label) in held.items()]
        if len(sent) > REMEMBERED:
            sent.clear()
        types = (pa.int64(), pa.string(), pa.int32(), pa.int64(), *[pa.int32()] * 5, pa.string(), pa.string())
        cols = list(zip(*rows, strict=True)) or [[]] * len(types)
        names = [c.split()[0] for c in UNIT_SCHEMA.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=names)


def _tables(c: str = "print"):
    """Keys of a fingerprint in all tables: the table's number and the values of its two blocks."""
    low, parts = 0, []
    for width in BLOCKS:
        parts.append(F.shiftrightunsigned(F.col(c), low).bitwiseAND((1 << width) - 1))
        low += width
    keys = [F.lit(k).cast("bigint") * F.lit(1 << 20) + parts[i] * F.lit(1 << 10) + parts[j] for k, (i, j) in enumerate(combinations(range(len(BLOCKS)), 2))]
    return F.array(*keys)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(BUCKETS, np.int64)
    for b in batches:
        if b.num_rows:
            counts += np.bincount((_hashes(b.column(0).to_pylist())[0] % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
    used = np.nonzero(counts)[0]
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["bucket", "n"])


def _prefixed(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, few, sizes = prefixes(b.column("text").to_pylist(), shared.value)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(few)].astype(np.int32)), pa.array(keys))
            prints = pa.array(fingerprints(b.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists, pa.array(sizes.astype(np.int32)), prints], names=[*b.schema.names, "keys", "size", "print"])

    return run


def with_prefixes(texts: DataFrame) -> DataFrame:
    """``texts`` (unit, text, label) with print for the SimHash tables, keys and size for the shingle search.

    The driver gets one count for each of ``BUCKETS``. Buckets only order the shingles, so that few texts
    share a key; the search is complete in any order.
    """
    found = texts.select("text").mapInArrow(_counted, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(BUCKETS, np.int64)
    counts[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    shared = texts.sparkSession.sparkContext.broadcast(counts)
    return texts.select("unit", "text", "label").mapInArrow(_prefixed(shared), "unit bigint, text string, label string, keys array<bigint>, size int, print bigint")


def _by_print(df: DataFrame) -> DataFrame:
    return df.where("print is not null").withColumn("key", F.explode(_tables()))


def _by_shingle(df: DataFrame) -> DataFrame:
    return df.select("*", F.posexplode("keys").alias("place", "key")).drop("keys")


def _print_close():
    return F.bit_count(F.col("print").bitwiseXOR(F.col("near_print"))) <= HAMMING


def _shingle_close():
    """Enough shingles are left from the shared one on; this holds at the first one that similar texts share."""
    left = F.least(F.col("size") - F.col("place"), F.col("near_size") - F.col("near_place"))
    return left * (1 + SIMILAR) >= SIMILAR * (F.col("size") + F.col("near_size")) - 1e-6


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = [similarity(x, y) >= SIMILAR for x, y in zip(b.column("text").to_pylist(), b.column("near").to_pylist(), strict=True)]
        yield b.filter(pa.array(keep, pa.bool_())).select(["unit", "label"])


def filler_words(texts: DataFrame) -> list[str]:
    """Words that stand far more often in sentences which begin as filler than elsewhere.

    All of them, as a filler vocabulary is one of words, which does not grow with the captures.
    """
    words = texts.where("label is null or label = 'filler'").select(F.explode(F.split("text", " ")).alias("w"), F.startswith("text", F.lit("lorem ipsum")).cast("int").alias("f"))
    words = words.select(F.regexp_replace("w", r"[^\p{L}]", "").alias("w"), "f").where("w <> ''")
    n = words.groupBy("w").agg(F.sum("f").alias("a"), F.count("*").alias("n"))
    total = n.agg(F.sum("a"), F.sum("n")).collect()[0]
    seeds, rest = total[0] or 0, (total[1] or 0) - (total[0] or 0)
    if not seeds:
        return []
    much = n.where((F.col("a") >= FILLER_COUNT) & (F.col("a") / F.lit(seeds) >= F.lit(FILLER_RATIO) * (F.col("n") - F.col("a") + 1) / F.lit(rest + 1)))
    return sorted(r["w"] for r in much.select("w").toLocalIterator())


def _filled(lexicon):
    """Label sentences that are made of filler words."""
    letters = re.compile(r"[\W\d_]+")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = frozenset(lexicon.value)
        for b in batches:
            labels = b.column("label").to_pylist()
            for i, (text, label) in enumerate(zip(b.column("text").to_pylist(), labels, strict=True)):
                if label is None and len(ws := [w for x in text.split(" ") if (w := letters.sub("", x))]) >= 6 and sum(w in known for w in ws) >= FILLER_SHARE * len(ws):
                    labels[i] = "filler"
            yield pa.RecordBatch.from_arrays([b.column("unit"), b.column("text"), pa.array(labels, pa.string())], names=["unit", "text", "label"])

    return run


def _kept(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``df`` as a written table, and its rows: what decides whether it may be broadcast."""
    kept = materialize(df, name)
    return kept, kept.count()


def _hint(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _pairs(texts: DataFrame, known: DataFrame, front: DataFrame, n: int, by_print: bool) -> DataFrame:
    """(unit, label) of the units not ``known`` yet that are similar to one of the ``n`` in ``front``; ids and fingerprints are sent, texts only fetched for close ones."""
    keyed, close, needs = (_by_print, _print_close(), ["print"]) if by_print else (_by_shingle, _shingle_close(), ["keys", "size"])
    probe = keyed(front.select(F.col("unit").alias("other"), "label", *needs))
    probe = probe.select("other", "label", "key", *[F.col(c).alias(f"near_{c}") for c in probe.columns if c not in ("other", "label", "key")])
    probe = _hint(probe, n * TABLES) if by_print else broadcast_if_small(probe)
    tables = keyed(texts.select("unit", *needs).join(known, "unit", "left_anti"))
    met, m = _kept(tables.join(probe, (tables["key"] == probe["key"]) & close).select("unit", "other", "label").distinct(), "pairs")
    with_text = _hint(met, m).join(texts.select("unit", "text"), "unit").join(_hint(front.select(F.col("unit").alias("other"), F.col("text").alias("near")), n), "other")
    return with_text.select("unit", "label", "text", "near").mapInArrow(_similar, "unit bigint, label string").groupBy("unit").agg(F.min("label").alias("label"))


def _spread(texts: DataFrame, known: DataFrame, front: DataFrame, rounds: int) -> DataFrame:
    """``known`` (unit, label) and all that hangs together with ``front`` by near-duplicates."""
    for by_print in [p for p, c in ((True, "print"), (False, "keys")) if c in texts.columns]:
        needs = [c for c in ("print", "keys", "size") if c in texts.columns]
        reached, edge, n = front, front, front.count()
        for k in range(rounds + 1):
            source = _hint(edge.select("unit", "label"), n).join(texts.select("unit", "text", *needs), "unit")
            fresh, n = _kept(_pairs(texts, broadcast_if_small(known.select("unit")), source, n, by_print), "spread")
            if not n:
                break
            if k == rounds:
                raise RuntimeError(f"labels still spread after {rounds} rounds")
            known, reached, edge = known.unionByName(fresh), reached.unionByName(fresh), fresh
        front = reached
    return known


def spread_labels(texts: DataFrame, rounds: int = 12) -> DataFrame:
    """(unit, label) of every unit in a connected component of near-duplicates with a trusted unit.

    ``texts``: unit, text, label (null if not trusted), one row per unit, and what the search needs: print
    for the SimHash tables, or keys and size (``with_prefixes``) for the shingle search, or both: then the
    tables go first and the shingle search, which finds every pair, adds what they miss. Each round
    searches the units labelled last among all units; it ends when nothing new is found, or fails loudly
    after ``rounds``. A unit reached with several labels takes the first in alphabetical order. Only pairs
    with a labelled side are formed, and exact copies are one unit, so no group of copies is paired with itself.
    """
    known = materialize(texts.where("label is not null").select("unit", "label"), "trusted")
    return _spread(texts, known, known, rounds)


#: A capture says no more than its message if so few words of its main part are not of it, or so large a share
#: of its units is; a unit belongs to messages if it stands in them at least so often.
FEW_WORDS, SHARE_OF_PAGE, SHARE_OF_UNIT = 25, 0.3, 0.5
#: The same share where two units at least are filler, which comes in many sentences.
SHARE_OF_FILLER = 0.2


def learn(stands: DataFrame, totals: DataFrame, known: DataFrame) -> DataFrame:
    """(unit, label) of further units which captures that are messages say, too.

    ``stands``: rows of ``UNIT_SCHEMA`` without texts; ``totals``: how many captures have a unit in their
    body. A unit has to stand in such captures of two URLs at least and, where it stands in a body, mostly
    in theirs. Units are joined to captures through labelled units only, so unlabelled ones stay out.
    """
    shown = stands.where(F.col("roles").bitwiseAND(MAIN) != 0)
    hit = shown.join(broadcast_if_small(known), "unit").where("label in ('error', 'script', 'filler')")
    hit = hit.groupBy("page_id").agg(F.count("*").alias("n"), F.sum("size").alias("s"), F.min("label").alias("label"), F.max("page_units").alias("pu"), F.max("page_size").alias("ps"), F.count_if(F.col("label") == "filler").alias("f"))
    filler = (F.col("f") >= 2) & (F.col("f") >= F.lit(SHARE_OF_FILLER) * F.col("pu"))
    says, n = _kept(hit.where((F.col("ps") - F.col("s") <= FEW_WORDS) | (F.col("n") >= F.lit(SHARE_OF_PAGE) * F.col("pu")) | filler).select("page_id", "label"), "messages")
    met = shown.where(F.col("roles").bitwiseAND(SAYS) != 0).join(_hint(says, n), "page_id")
    met = met.groupBy("unit").agg(F.count("*").alias("n"), F.min("label").alias("label"), (F.min("site") != F.max("site")).alias("sites"))
    met = met.where("sites").join(known.select("unit"), "unit", "left_anti")
    return met.join(totals, "unit").where(F.col("n") >= F.lit(SHARE_OF_UNIT) * F.col("total")).select("unit", "label")


def labelled(pages: DataFrame, rounds: int = 12) -> tuple[DataFrame, DataFrame]:
    """Units of all captures (``UNIT_SCHEMA``) and the labels (unit, label) of residue units.

    Trusted labels spread over near-duplicates, then through captures to what else they say, and again
    until nothing new is found.
    """
    site = F.col("url") if "url" in pages.columns else F.col("page_id").cast("string")
    cut = materialize(pages.select("page_id", site.alias("site"), "html").mapInArrow(_cut, UNIT_SCHEMA), "units")
    texts = cut.where("text is not null").groupBy("unit").agg(F.min("text").alias("text"), F.min("label").alias("label"))
    texts = materialize(texts, "texts")
    lexicon = filler_words(texts)
    if lexicon:
        texts = texts.mapInArrow(_filled(pages.sparkSession.sparkContext.broadcast(lexicon)), "unit bigint, text string, label string")
    texts = materialize(with_prefixes(texts), "texts")
    stands = cut.drop("text", "label")
    body = F.when(F.col("roles").bitwiseAND(ROLES["body"]) != 0, 1).otherwise(0)
    totals = materialize(stands.where(F.col("roles").bitwiseAND(SAYS) != 0).groupBy("unit").agg(F.sum(body).alias("total")), "totals")
    known = front = materialize(texts.where("label is not null").select("unit", "label"), "trusted")
    for _ in range(rounds):
        known = _spread(texts, known, front, rounds)
        front = None
        for _ in range(rounds):
            fresh, n = _kept(learn(stands, totals, known), "learned")
            if not n:
                break
            known, front = known.unionByName(fresh), fresh if front is None else front.unionByName(fresh)
        if front is None:
            return stands, known
    raise RuntimeError(f"labels still spread after {rounds} rounds")


def residue_pages(pages: DataFrame) -> DataFrame:
    """(page_id, kinds): captures (page_id, html and, if there is one, url) with residue, and its sorted kinds.

    A placeholder token or a note to the author counts in the title, the description or visible text, even
    beside real content. Filler, an error message or a call for scripts counts where no real sentence
    stands in the body, or no more than ``FEW_WORDS`` under a heading that is an error message. Null and empty html is no case; repeated captures are judged alike.
    """
    found, labels = labelled(pages)
    in_role = lambda mask: F.col("roles").bitwiseAND(mask) != 0
    per_page = found.join(broadcast_if_small(materialize(labels, "labels")), "unit").groupBy("page_id").agg(
        F.max(F.col("label").isin("token", "note") & in_role(127 - ROLES["noscript"])).alias("template"),
        F.max(F.col("label").isin("error", "script", "filler") & in_role(MAIN)).alias("message"),
        (F.max("page_real") - F.coalesce(F.sum(F.when(in_role(ROLES["body"]), F.col("words"))), F.lit(0))).alias("real"),
        F.max((F.col("label") == "error") & in_role(ROLES["head"])).alias("headed"),
        (F.max("page_size") - F.sum(F.when(in_role(MAIN), F.col("size")).otherwise(0))).alias("rest"),
        F.array_sort(F.collect_set("label")).alias("kinds"),
    )
    alone = (F.col("real") == 0) | (F.col("headed") & (F.col("rest") <= FEW_WORDS))
    return per_page.where(F.col("template") | (F.col("message") & alone)).select("page_id", "kinds")
