"""Personal data: fixed rules and a semi-Markov conditional random field over whole spans.

The rules give the base spans. The field reads the neighbourhood of every word with a digit or ``@`` and scores
whole candidate segments of up to ``LONGEST`` words: counts of digits, dots and groups, check sums, hex runs,
brackets, a leading plus, the word before. Dynamic programming over bounded segments chooses boundaries and kinds
together. Its spans are added where they overlap no base span; kind ``secret`` exists only there.

It is trained by gradient ascent on the conditional likelihood of segmentations of at most ``SAMPLE`` regions that
hold a labelled span and as many that hold none (the first of all by a hash of their text), labelled by the rules; for
phones a copy without the plus sign is added, so that the field learns forms which the rules miss.

Rows: null and empty texts have no spans; rows without doc_id are left out; repeated rows are scanned each;
overlapping finds of different kinds all stay in the base. Texts are read whole; a region's cost is linear in
its words. Other columns are ignored.
"""

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlag.llm.texts import keyed
from fleetlag.session import cut_lineage

KINDS = ["email", "ip", "card", "phone"]
LABELS = ["other", *KINDS, "secret"]
LONGEST = 6
AROUND = 2
SAMPLE = 400
ROUNDS = 25
RATE = 0.3
PENALTY = 1e-3

# The base rules.
EMAIL_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
EMAIL_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_TRIGGER = re.compile(r"[0-9@]")
_DIGITS = re.compile(r"[0-9]")
_WORD = re.compile(r"\S+")
_CUES = ["token", "key", "secret", "password", "phone", "tel", "mail", "card", "="]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches without overlap, found from their ``@``: cost is linear in the text."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = EMAIL_DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The rules' spans by kind as listed, then start."""
    out = [("email", a, b) for a, b in emails(text)]
    if _DIGITS.search(text):
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(_octet(p) for p in m.group().split("."))]
        for m in CARD.finditer(text):
            digits = "".join(_DIGITS.findall(m.group())) if m.end() - m.start() >= 13 else ""
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(_DIGITS.findall(m.group())) <= 15:
                    out.append(("phone", *m.span()))
    return out


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def regions(text: str) -> list[list[tuple[int, int]]]:
    """Runs of words (start, end) around the words with a digit or ``@``."""
    out: list[list[tuple[int, int]]] = []
    n, last = len(text), -1
    m = _TRIGGER.search(text)
    while m:
        a = m.start()
        while a > 0 and not text[a - 1].isspace():
            a -= 1
        words, left = [], a
        for _ in range(AROUND):  # words before
            e = left
            while e > 0 and text[e - 1].isspace():
                e -= 1
            s = e
            while s > 0 and not text[s - 1].isspace():
                s -= 1
            if s == e or e <= last:
                break
            words.insert(0, (s, e))
            left = s
        if out and not words and last >= 0 and a >= last:
            words = out.pop()  # it touches the region before
        quiet, end = 0, a
        for w in _WORD.finditer(text, a):
            quiet = 0 if _TRIGGER.search(w.group()) else quiet + 1
            words.append(w.span())
            end = w.end()
            if quiet > AROUND:
                break
        out.append(words)
        last = end
        m = _TRIGGER.search(text, end) if end < n else None
    return out




def trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    """Span without quotes and closing punctuation around it."""
    while a < b and text[a] in "\"'<[{":
        a += 1
    while b > a and text[b - 1] in "\"'])}>.,;:!?#$%&*|":
        b -= 1
    return a, b


def segment_features(text: str, words: list[tuple[int, int]], i: int, j: int) -> np.ndarray:
    """Whole-span features of words ``i..j`` inclusive."""
    a, b = trimmed(text, words[i][0], words[j][1])
    s = text[a:b]
    digits = "".join(_DIGITS.findall(s))
    n, d = len(s), len(digits)
    groups = re.findall(r"[0-9]+", s)
    dots = s.count(".")
    plain = sum(c in "0123456789 ()-.+" for c in s)
    hexa = re.fullmatch(r"[0-9A-Fa-f]{20,}", s) is not None
    before = text[words[max(0, i - 2)][0] : words[i][0]].lower() if i else ""
    f = [
        1.0, n == 0, j == i, j - i == 1, j - i == 2, j - i > 2, d == 0, 0 < d < 7, 7 <= d <= 8, 9 <= d <= 12, d == 10,
        13 <= d <= 15, d == 16, 16 < d <= 19, d > 19, n > 0 and d == n, n > 0 and plain == n, "@" in s,
        "@" in s and "." in s[s.find("@") :], s.count("@") > 1, s[:1] == "+", s[:1] == "(", "(" in s and ")" in s,
        dots == 3, dots == 3 and len(groups) == 4 and all(_octet(g) for g in groups) and plain == n,
        13 <= d <= 19 and plain == n and luhn(digits), len(groups) == 1, len(groups) == 2, len(groups) == 3, len(groups) == 4,
        len(groups) > 4, hexa, hexa and 0 < d < n, n >= 20 and j == i, "-" in s, s.isalpha(), bool(j > i and s[:1].isalpha()),
        bool(j > i and s[-1:].isalpha()), *[cue in before for cue in _CUES],
    ]
    return np.array(f, float)


def candidate_matrix(text, words):
    """Features of all segments of a region: row ``i * LONGEST + (length - 1)``; unused rows are zero."""
    n = len(words)
    width = len(segment_features("", [(0, 0)], 0, 0))
    out = np.zeros((n * LONGEST, width))
    for i in range(n):
        for length in range(1, min(LONGEST, n - i) + 1):
            out[i * LONGEST + length - 1] = segment_features(text, words, i, i + length - 1)
    return out


def segment_scores(matrix: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Scores by word, length and label; ``other`` segments have one word."""
    s = np.einsum("nf,fl->nl", matrix, weights).reshape(-1, LONGEST, len(LABELS))
    s[:, 1:, 0] = -np.inf
    return s


def best_segments(scores: np.ndarray) -> list[tuple[int, int, int]]:
    """Most probable segmentation: (first word, last word, label) of the labelled segments."""
    n = len(scores)
    best, link = np.full(n + 1, -np.inf), [None] * (n + 1)
    best[0] = 0
    top, label = scores.max(axis=2), scores.argmax(axis=2)
    for i in range(n):
        for length in range(1, min(LONGEST, n - i) + 1):
            v = best[i] + top[i, length - 1]
            if v > best[i + length]:
                best[i + length], link[i + length] = v, (i, int(label[i, length - 1]))
    out, end = [], n
    while end > 0:
        i, k = link[end]
        if k:
            out.append((i, end - 1, k))
        end = i
    return out[::-1]


def expected(scores: np.ndarray) -> np.ndarray:
    """Probability of every segment and label (forward and backward sums)."""
    n = len(scores)
    flat = np.logaddexp.reduce(scores, axis=2)
    ahead, back = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    ahead[0] = back[n] = 0
    for i in range(n):
        for length in range(1, min(LONGEST, n - i) + 1):
            ahead[i + length] = np.logaddexp(ahead[i + length], ahead[i] + flat[i, length - 1])
    for i in range(n - 1, -1, -1):
        for length in range(1, min(LONGEST, n - i) + 1):
            back[i] = np.logaddexp(back[i], flat[i, length - 1] + back[i + length])
    p = np.zeros_like(scores)
    for length in range(1, LONGEST + 1):
        m = n - length + 1
        if m > 0:
            p[:m, length - 1] = np.exp(
                np.clip(scores[:m, length - 1] + (ahead[:m] + back[length : n + 1] - ahead[n])[:, None], -700, 0)
            )
    return p


def gold_segments(text, words) -> list[tuple[int, int, int]]:
    """Labelled segments of a training region by the rules; a long hex word behind ``=`` is a secret."""
    out, taken = [], set()
    spans = base_spans(text) + [
        ("secret", *m.span(1)) for m in re.finditer(r"=\s*[\"']?([0-9A-Fa-f]{20,})", text)
    ]
    for kind, a, b in spans:
        inside = [k for k, (s, e) in enumerate(words) if s < b and e > a]
        if inside and len(inside) <= LONGEST and not taken.intersection(inside):
            if trimmed(text, words[inside[0]][0], words[inside[-1]][1]) == (a, b):
                taken.update(inside)
                out.append((inside[0], inside[-1], LABELS.index(kind)))
    return out


def train(samples: list[str]) -> np.ndarray:
    """Weights (features by labels) from region texts."""
    data = []
    copies = [re.sub(r"\+[0-9]{1,3}[ -]?(?=\()", "", t) if PHONE.search(t) else t for t in samples]
    for text, plain in zip(samples, copies):
        words = [m.span() for m in _WORD.finditer(text)]
        gold = gold_segments(text, words)
        data.append((text, words, gold))
        if plain != text:
            out, phone = [], LABELS.index("phone")
            short = [m.span() for m in _WORD.finditer(plain)]
            lost = len(words) - len(short)
            for a, b, k in gold:
                shift = lost if k == phone and lost in (0, 1) else 0
                out.append((a, b - shift, k))
            if len(gold) == 1 and out[0][1] < len(short):
                data.append((plain, short, out))
    width = len(segment_features("", [(0, 0)], 0, 0))
    w = np.zeros((width, len(LABELS)))
    made = []
    for text, words, gold in data:
        if not words:
            continue
        target = np.zeros((len(words), LONGEST, len(LABELS)))
        free = np.ones(len(words), bool)
        for a, b, k in gold:
            target[a, b - a, k] = 1
            free[a : b + 1] = False
        target[free, 0, 0] = 1
        made.append((candidate_matrix(text, words), target.reshape(-1, len(LABELS))))
    squares = np.full_like(w, 1e-6)
    for _ in range(ROUNDS):
        slope = np.zeros_like(w)
        for matrix, target in made:
            p = expected(segment_scores(matrix, w)).reshape(-1, len(LABELS))
            slope += np.einsum("nf,nl->fl", matrix, target - p)
        slope = slope / max(1, len(made)) - PENALTY * w
        squares += slope**2
        w = w + RATE * slope / np.sqrt(squares)
    return w


def training_regions(docs: DataFrame, sample: int = SAMPLE) -> list[str]:
    """At most ``sample`` region texts with a labelled span and as many without, the first by a hash of their text."""

    def run(batches):
        for b in batches:
            out: dict[str, bool] = {}
            for text in b["text"].to_pylist():
                for words in regions(text):
                    part = text[words[0][0] : words[-1][1]]
                    if len(words) <= 40 and len(part) <= 2000:
                        out[part] = bool(gold_segments(part, [m.span() for m in _WORD.finditer(part)]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(out), pa.string()), pa.array(list(out.values()), pa.bool_())], ["part", "labelled"]
            )

    found = cut_lineage(keyed(docs).select("text").mapInArrow(run, "part string, labelled boolean").distinct())
    pick = lambda rows: [r["part"] for r in rows.orderBy(F.xxhash64("part"), "part").limit(sample).collect()]
    return pick(found.where("labelled")) + pick(found.where("NOT labelled"))


def field_spans(text: str, weights: np.ndarray) -> list[tuple[str, int, int]]:
    out = []
    for words in regions(text):
        for a, b, k in best_segments(segment_scores(candidate_matrix(text, words), weights)):
            s, e = trimmed(text, words[a][0], words[b][1])
            if s < e:
                out.append((LABELS[k], s, e))
    return out


def all_spans(text: str, base, weights) -> list[tuple[str, int, int]]:
    """Base spans and the field's spans that overlap none of them, by kind, then start."""
    used = sorted((a, b) for _, a, b in base)
    starts, reach = [a for a, _ in used], list(accumulate((b for _, b in used), max))  # the furthest end up to each start

    def free(start, end):
        before = bisect_left(starts, end)
        return not before or reach[before - 1] <= start

    added = [x for x in field_spans(text, weights) if free(x[1], x[2])]
    return sorted([*base, *added], key=lambda x: (LABELS.index(x[0]), x[1], x[2]))


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """One row per document: base counts, digest of the base spans, all spans."""
    w = train(training_regions(docs)) if weights is None else weights

    def run(batches):
        for b in batches:
            rows = []
            for text in b["text"].to_pylist():
                if not _TRIGGER.search(text):
                    rows.append((0, 0, 0, 0, _EMPTY, ""))
                    continue
                base = base_spans(text)
                count = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                rows.append((*count, hashlib.sha256(joined(base).encode()).hexdigest(), joined(all_spans(text, base, w))))
            columns = list(zip(*rows)) or [[]] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"],
            )

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return keyed(docs).mapInArrow(run, schema)


_EMPTY = hashlib.sha256(b"").hexdigest()


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans count as one."""
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def mask(docs: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """All rows and columns, with the spans of every text replaced by their kind; ``n_chars`` follows the text."""
    w = train(training_regions(docs)) if weights is None else weights

    def run(batches):
        for b in batches:
            out = []
            for text in b["text"].to_pylist():
                found = all_spans(text, base_spans(text), w) if text and _TRIGGER.search(text) else []
                out.append(masked(text, found) if found else text)
            columns = {name: b.column(i) for i, name in enumerate(b.schema.names)}
            columns["text"] = pa.array(out, pa.string())
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([None if t is None else len(t) for t in out], pa.int64())
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    kinds = [f"`{name}` {'long' if name == 'n_chars' else kind}" for name, kind in docs.dtypes]
    return docs.mapInArrow(run, ", ".join(kinds))
