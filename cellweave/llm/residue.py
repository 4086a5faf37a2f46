"""Template residue and error-page text: positive-unlabelled naive Bayes over passages, learnt by expectation-maximization.

A record is cut into passages of two kinds: marks (stretches with signs, and names of missing values) and sentences without
their marks. Some passages are labelled by a few patterns; the labels only teach the model. Every decision, also about a
labelled passage, is the model's.
"""

from __future__ import annotations

import html
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage

HALF = 1 << 20
BUCKETS = 2 * HALF  # of hashed features; bounds the model and all that reaches the driver
_CODES = 1 << 29  # a feature is known by a code below this
_VIEW = _CODES  # bit of a feature: of a mark its shape, of a sentence a word
MARK, TRUSTED, QUOTED = 1, 2, 4  # bits of a passage

# Elements of HTML that are markup and no placeholder.
_ELEMENTS = "a|b|i|u|p|s|br|hr|em|strong|span|div|table|tr|td|th|ul|ol|li|h[1-6]|img|sup|sub|pre|code|small|big|center|font|body|html|head|script|style"
_MARKUP = regex.compile(rf"(?i)</?(?:{_ELEMENTS})(?:\s[^<>]*)?/?>|<\|[^<>|]*\|>|\x1b\[[0-9;]*m")
_SILENT = regex.compile(r"[\p{Cf}\p{Variation_Selector}]+")
_CUT = regex.compile(r"\n+|\s\|\s|(?i:</?noscript>)|(?<=[.!?…])\s+|(?<=[。！？؟।])\s*")
_NOSCRIPT = regex.compile(r"(?i)<noscript>(.*?)(?:</noscript>|$)", regex.S)

# How programs print a value that is missing.
_MISSING = "undefined|null|NaN|None|nil"
_SIGN = r"{}\[\]<>%$@#~|*^&_\\=`«»‹›()"
_QUOTE = r"\"“”„‘’'"
_CJK = r"\p{Han}\p{Hiragana}\p{Katakana}。、！？"
_HINT = re.compile(rf"[{_SIGN}]|\w[._:]\w|{_MISSING}")
_MARKS = regex.compile(
    rf"(?<![^\s{_CJK}])[{_QUOTE}]?[{_SIGN}][{_SIGN}?!%]*(?:[^\s{_SIGN}]+|\[\d+\])?(?:[ ][^\s{_SIGN}]+){{0,3}}?[ ]?[^\s{_SIGN}{_CJK}]*[{_SIGN}](?:[^\s{_CJK}]*)"  # opened and closed, up to four words
    rf"|[^\s{_CJK}]*(?:[{_SIGN}]|\w[._:]\w)[^\s{_CJK}]*"  # one chunk
    rf"|(?<![^\s{_CJK}])(?:{_MISSING})(?!\w)(?: (?:{_MISSING})(?!\w))*"
)
_WORD = regex.compile(r"\p{Han}+|\p{Hiragana}+|\p{Katakana}+|(?:(?![\p{Han}\p{Hiragana}\p{Katakana}])[\p{L}\p{M}])+|\p{N}+|\x02|[^\s\p{L}\p{M}\p{N}]")
_INNER = regex.compile(r"[\p{L}\p{M}]+|\p{N}+")
_CAMEL = regex.compile(r"(?<=\p{Ll})(?=\p{Lu})")
_LETTERS, _DIGITS, _NAME = regex.compile(r"[\p{L}\p{M}]+"), regex.compile(r"\p{N}+"), regex.compile(r"a(?:[ _.\-]a)+")
_OPENING, _CLOSING = regex.compile(r"[^\p{L}\p{M}\p{N}]*"), regex.compile(r"[^\p{L}\p{M}\p{N}]*$")

# Labels of the commonest placeholders and unresolved values.
TRUSTED_MARK = regex.compile(
    r"(?:\{\{\{?[^{}\n]{1,60}\}?\}\}|\{%[^{}\n]{1,60}%\}|[$#]\{[^{}\n]{1,60}\}|\[\[[^\[\]\n]{1,60}\]\]|<%=? ?[^<>%\n]{1,60}%>|<\?(?:php echo|=) [^<>?\n]{1,60}\?>|\[object Object\]|#REF|%s|%\d\$s|\{[01]\}|@Model\.\w+|\((?:TBD|TODO): [^()]{1,40}\)"
    r"|«[^«»]{1,40}»_missing|\(?(?:(?i:http|err(?:or)?|status|code|e)[ _=:/-]?\d{3,5}|HTTP/1\.\d(?: \d{3})?)\)?"
    rf"|\[(?:INSERT|TODO|your) [^\[\]]{{1,40}}\]|(?:{_MISSING})(?: (?:{_MISSING}))+)"
)
QUOTED_MARK = regex.compile(rf"[{_QUOTE}«‹`].*[{_QUOTE}»›`]")  # a text speaks of it: a label against
# Labels of a line that gives a status code, and of a program's own report.
TRUSTED_CODE = regex.compile(r"(?i)\s*(?:(?:http(?:/[\d.]+)?|error|status|code|fehler|erreur|erro)[ =:]*[45]\d\d\b|[45]\d\d\s*$|[45]\d\d[ :.-]+\p{Lu})")
TRUSTED_REPORT = re.compile(r"(?i)traceback \(most recent|\bat [\w.$]+\(\w+\.java:\d+\)|sqlstate\[")
# Labels of filler, and of what asks for scripts outside a noscript element.
TRUSTED_LATIN = {"lorem", "ipsum", "dolor", "amet", "elit"}  # three of these
TRUSTED_LINE = re.compile(
    r"(?i)\b(?:goes here|placeholder for|click to edit)\b|^(?:sample text ?){2}|^replace this|^hier steht (?:später )?ihr text|^seu texto aqui|^su texto (?:va )?aquí"
    r"|^texte de remplissage|^здесь будет ваш текст|^ここに文章を入力|^(?:please )?(?:enable|allow|turn on) (?:javascript|js|scripts)"
)


def plain(text: str) -> str:
    """The text without escapes, markup elements and invisible characters, in composed form."""
    while "&" in text:
        once = html.unescape(text)
        if once == text:
            break
        text = once
    if not text.isascii():
        text = _SILENT.sub("", unicodedata.normalize("NFC", text))
    return _MARKUP.sub(" ", text) if "<" in text or "\x1b" in text else text


def _norm(word: str) -> str:
    if word[0].isnumeric():
        return "4xx" if len(word) == 3 and word[0] in "45" else "0" * min(len(word), 5)
    word = word.lower()
    return "=" if len(word) > 1 and len(set(word)) == 1 else word  # one letter over and over


def _hash(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) & (_CODES - 1)


def buckets_of(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two buckets of every feature, one in each half: a feature that shares one with a common feature seldom shares both."""
    c = codes.astype(np.int64) & (_CODES - 1)
    return c & (HALF - 1), HALF + ((c * 0x9E3779B1 >> 13) & (HALF - 1))


def _count(codes: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    return sum(np.bincount(b, weights, BUCKETS) for b in buckets_of(codes))


def _mark(line: str, begin: int, end: int) -> tuple[str, list[int]]:
    """A mark's features: its shape and signs (one view), and the names in it and the words beside it (the other)."""
    s = line[begin:end].rstrip(".,;:!?…") or line[begin:end]
    names = [_norm(w) for c in _INNER.findall(s) for w in ([c] if c.islower() or c.isupper() else _CAMEL.split(c))]
    before, after = _WORD.findall(line[max(0, begin - 25) : begin]), _WORD.findall(line[end : end + 25])
    shape = s.lower() if s.replace(" ", "").isalpha() else _NAME.sub("a", _DIGITS.sub("0", _LETTERS.sub("a", s)))
    opening, closing = _OPENING.match(s).group(), _CLOSING.search(s).group()
    form = [f"mS{shape}", *([f"mO{opening}"] if opening else []), *([f"mC{closing}"] if closing else [])]
    rest = [f"mW{w}" for w in dict.fromkeys(names)] + [f"mX{' '.join(names[:4])}", f"mB{_norm(before[-1]) if before else '^'}", f"mA{_norm(after[0]) if after else '$'}"]
    return s, [_hash(f) | _VIEW for f in form] + [_hash(f) for f in rest]


class Cutter:
    """Passages of texts as hashed features; words met before are looked up."""

    def __init__(self) -> None:
        self._known: dict[str, tuple[str, int]] = {}

    def _word(self, w: str) -> tuple[str, int]:
        found = self._known.get(w)
        if found is None:
            if len(self._known) > 500_000:
                self._known.clear()
            n = _norm(w)
            found = self._known[w] = (n, _hash(n) | (_VIEW if n[0].isalpha() or n in ("=", "4xx") else 0))
        return found

    def _sentence(self, words: list[tuple[str, int]]) -> list[int]:
        """Every word once, then every pair of neighbours, ends included, once."""
        codes = [h for _, h in words]
        framed = [1, *codes, 2]
        pairs = {((a & (_CODES - 1)) * 0x9E3779B1 + (b & (_CODES - 1)) * 0x85EBCA77 >> 9) & (_CODES - 1) for a, b in zip(framed, framed[1:], strict=False)}
        return [*dict.fromkeys(codes), *pairs]

    def passages(self, text: str) -> tuple[list[list[int]], list[int]]:
        """(features of every passage, its bits)."""
        features: list[list[int]] = []
        bits: list[int] = []
        raw = plain(text)
        asking = {p.strip() for m in _NOSCRIPT.findall(raw) for p in _CUT.split(m)} if "noscript" in raw.lower() else ()
        coded = False
        for line in _CUT.split(raw):
            if not line or line.isspace():
                continue
            after_code, coded = coded, bool(TRUSTED_CODE.match(line))
            known = TRUSTED if coded or after_code or line.strip() in asking or TRUSTED_REPORT.search(line) or TRUSTED_LINE.search(line) else 0
            rest = line
            if _HINT.search(line):
                parts, at = [], 0
                for m in _MARKS.finditer(line):
                    s, f = _mark(line, m.start(), m.end())
                    features.append(f)
                    bits.append(MARK | (TRUSTED if TRUSTED_MARK.fullmatch(s) else QUOTED if QUOTED_MARK.fullmatch(s) else 0))
                    parts.append(line[at : m.start()])
                    at = m.end()
                rest = " \x02 ".join([*parts, line[at:]])
            words = [self._word(w) for w in _WORD.findall(rest)]
            if sum(w in TRUSTED_LATIN for w, _ in words) >= 3:
                known = TRUSTED
            kept: list[tuple[str, int]] = []
            i = 0
            while i < len(words):  # a word three times in a row, or more, is a passage of its own
                j = i
                while j + 1 < len(words) and words[j + 1][1] == words[i][1] and words[i][1] & _VIEW:
                    j += 1
                if j - i >= 2:
                    features.append([words[i][1], _hash("\x02repeated") | _VIEW])
                    bits.append(TRUSTED)
                    kept.append(("\x02", 3))
                else:
                    kept += words[i : j + 1]
                i = j + 1
            # a sentence has a word of two letters, one of a script without spaces, or nothing but a code
            if [w for w, _ in kept] == ["4xx"] or any(h & _VIEW and w != "4xx" and (len(w) > 1 or w == "=" or ord(w) > 0x2E7F) for w, h in kept):
                features.append(self._sentence(kept))
                bits.append(known)
        return features, bits


def passages(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(d, f, n, bits): for every record the features of all its passages one after another, their numbers, and their bits."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter()
        for batch in batches:
            flat, sizes, bits = [], [], []
            for t in batch.column("t").to_pylist():
                f, b = cutter.passages(t)
                flat.append([x for p in f for x in p]), sizes.append([len(p) for p in f]), bits.append(b)
            yield pa.RecordBatch.from_arrays([batch.column("d"), *[pa.array(c, pa.list_(pa.int32())) for c in (flat, sizes, bits)]], names=["d", "f", "n", "bits"])

    source = docs.where(F.col(doc_id).isNotNull() & (F.length(text) > 0)).select(F.col(doc_id).alias("d"), F.col(text).alias("t"))
    return source.mapInArrow(cut, f"d {dict(source.dtypes)['d']}, f array<int>, n array<int>, bits array<int>")


class Model:
    """Log odds of every feature, and for marks [1] and sentences [0] the prior's log odds: alone, and beside residue of the same kind."""

    def __init__(self, weights: np.ndarray, seen: np.ndarray, alone: np.ndarray, beside: np.ndarray, coverage: float, first: bool):
        self.weights, self.seen, self.alone, self.beside, self.coverage, self.first = weights, seen, alone, beside, coverage, first

    def judge(self, batch: pa.RecordBatch, labelled: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(probability, probability that the record holds other residue of the kind, features, their passages, passages' records).

        A sentence fewer than ``coverage`` of whose words speak for residue is none, unless it stands beside residue: one
        that mentions an error shares some words with residue but says other things too. With ``labelled`` the labels
        hold, as in learning; the final decisions are made without.
        """
        sizes, bits = batch.column("n").flatten().to_numpy(), batch.column("bits").flatten().to_numpy()
        record = np.repeat(np.arange(batch.num_rows), np.diff(batch.column("n").offsets.to_numpy()))
        coded = batch.column("f").flatten().to_numpy()
        owner = np.repeat(np.arange(len(sizes)), sizes)
        one, two = buckets_of(coded)
        flat, view = np.where(self.seen[one] <= self.seen[two], one, two), coded >= _VIEW  # the bucket less shared
        mark = (bits & MARK).astype(np.int64)
        own = self.weights[mark[owner], flat].astype(float)
        if self.first:  # labels of marks were chosen by shape: at first only names and neighbours speak, and only for
            own = np.where(mark[owner] == 1, np.where(view, 0.0, np.maximum(own, 0.0)), own)
        score = np.bincount(owner, own, len(sizes))
        words = view & (mark[owner] == 0)
        share = np.bincount(owner[words], self.weights[0, flat[words]] > 0, len(sizes)) / np.maximum(1, np.bincount(owner[words], minlength=len(sizes)))
        thin = (mark == 0) & (share < self.coverage)

        def probability(log_odds: np.ndarray, excluded: np.ndarray) -> np.ndarray:
            p = np.where(excluded, 0.0, 1 / (1 + np.exp(-np.clip(log_odds, -60, 60))))
            return np.where(bits & TRUSTED, 1.0, np.where(bits & QUOTED, 0.0, p)) if labelled else p

        if self.first:
            thin |= (mark == 1) & (score + self.alone[1] < 0)  # and no mark counts in part
        group = record * 2 + mark
        before = np.log1p(-np.minimum(probability(score + self.alone[mark], thin), 1 - 1e-12))
        other = np.clip(1 - np.exp(np.bincount(group, before, 2 * batch.num_rows)[group] - before), 0, 1)
        prior = other * self.beside[mark] + (1 - other) * self.alone[mark]
        return probability(score + prior, thin & ((other < 0.5) | (mark == 1))), other, coded, owner, record


def _log_odds(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


def learn(table: DataFrame, coverage: float = 0.65, shrink: tuple[float, float] = (3.0, 1.0), most: int = 40, close: float = 5e-3) -> Model:
    """The model, from passages, by expectation-maximization until the expected residue changes by less than ``close``.

    Trusted passages stay positive and quoted marks negative while it learns; the others begin as negative and get the
    probability that the model gives them. A feature's evidence is shrunk towards none by ``shrink`` passages (of sentences,
    of marks), so words seen once or twice say little. Counts are over all passages; a round ships only the features of
    passages whose probability is above 1e-6, which is all that can change a count.
    """
    spark = table.sparkSession

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, totals = np.zeros(BUCKETS), np.zeros(2)
        for batch in batches:
            seen += _count(batch.column("f").flatten().to_numpy())
            totals += np.bincount(batch.column("bits").flatten().to_numpy() & MARK, minlength=2)
        k = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(k, [-1, -2]).astype(np.int32)), pa.array(np.append(seen[k], totals))], names=["k", "n"])

    def gathered(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """(value of every bucket, values of the keys -1, -2, …): at most one row a bucket."""
        got = rows.groupBy("k").agg(F.sum("n").alias("n")).toArrow()
        out, extra = np.zeros(BUCKETS, dtype=np.float32), np.zeros(12)
        for batch in got.to_batches():
            k, n = batch.column("k").to_numpy(), batch.column("n").to_numpy()
            out[k[k >= 0]], extra[-k[k < 0] - 1] = n[k >= 0], n[k < 0]
        return out, extra

    seen, totals = gathered(table.mapInArrow(every, "k int, n double"))
    totals = np.maximum(totals[:2], 1.0)
    model, before = None, None
    for turn in range(most):
        held = spark.sparkContext.broadcast(model)

        def expect(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            model = held.value
            positive, sums = np.zeros(BUCKETS), np.zeros((5, 2))
            for batch in batches:
                bits = batch.column("bits").flatten().to_numpy()
                if not len(bits):
                    continue
                mark = bits & MARK
                if model is None:
                    sizes = batch.column("n").flatten().to_numpy()
                    p, owner = (bits & TRUSTED > 0).astype(float), np.repeat(np.arange(len(sizes)), sizes)
                    coded, other = batch.column("f").flatten().to_numpy(), np.zeros(len(bits))
                else:
                    p, other, coded, owner, _ = model.judge(batch, True)
                some = p[owner] > 1e-6
                positive += _count(coded[some], p[owner[some]])
                for i, v in enumerate((p, p * other, other, p * (1 - other), 1 - other)):
                    sums[i] += np.bincount(mark, v, 2)
            k = np.flatnonzero(positive)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(k, -1 - np.arange(10)).astype(np.int32)), pa.array(np.append(positive[k], sums.ravel()))], names=["k", "n"])

        positive, extra = gathered(table.mapInArrow(expect, "k int, n double"))
        held.destroy()
        expected, with_other, other, alone, no_other = extra[:10].reshape(5, 2)
        share = np.clip(expected / totals, 1e-5, 0.5)
        # features of the two kinds are told apart by name; a bucket's evidence is taken against the share of the kind that asks
        weights = np.empty((2, BUCKETS), dtype=np.float32)
        for at in range(0, BUCKETS, 1 << 17):
            part = slice(at, at + (1 << 17))
            plus, every_ = positive[part].astype(float), seen[part].astype(float)
            for kind, (s, r) in enumerate(zip(shrink, share, strict=True)):
                weights[kind, part] = np.log((plus + s) / (every_ * r + s)) - np.log((np.maximum(every_ - plus, 0) + s) / (every_ * (1 - r) + s))
        if turn == 0:
            prior_alone = prior_beside = _log_odds(np.clip(share, 1e-5, 0.9))
        else:
            prior_alone = _log_odds(np.clip((alone + 0.5) / (no_other + 1), 1e-5, 0.9))
            prior_beside = _log_odds(np.clip((with_other + 0.5) / (other + 1), 1e-4, 0.9))
        model = Model(weights, seen, prior_alone, prior_beside, coverage, turn == 0)
        if before is not None and np.abs(expected - before).sum() <= close * max(1.0, expected.sum()):
            break
        before = expected
    model.first = False
    return model


def residue_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", coverage: float = 0.65) -> DataFrame:
    """(doc_id, probability, labelled): of every record with a text, the probability that any passage of it is residue.

    The passages' probabilities are aggregated as those of independent events. ``labelled`` says whether a pattern had
    labelled a passage of it for learning; it has no part in the probability.
    """
    spark = docs.sparkSession
    table = stage(passages(docs, doc_id, text), "passages")
    held = spark.sparkContext.broadcast(learn(table, coverage))  # two numbers per bucket

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            p, _, _, _, record = held.value.judge(batch, False)
            none = np.exp(np.bincount(record, np.log1p(-np.minimum(p, 1 - 1e-12)), batch.num_rows))
            told = np.bincount(record, batch.column("bits").flatten().to_numpy() & TRUSTED, batch.num_rows) > 0
            yield pa.RecordBatch.from_arrays([batch.column("d"), pa.array(1 - none), pa.array(told)], names=["d", "probability", "labelled"])

    return table.mapInArrow(score, f"d {dict(table.dtypes)['d']}, probability double, labelled boolean").withColumnRenamed("d", doc_id)


def residue_records(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5, coverage: float = 0.65) -> DataFrame:
    """(doc_id): records whose probability of holding residue exceeds ``threshold``.

    Null and empty texts have no passages; rows with a null id are left out; repeated rows are reported once; an empty
    table gives none; extra columns are ignored. All counts are over all passages of whole texts.
    """
    return residue_scores(docs, doc_id, text, coverage).where(F.col("probability") > threshold).select(doc_id).distinct()
