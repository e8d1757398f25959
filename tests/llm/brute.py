"""Plain reference versions of the operators' contracts; rows are (doc_id, text) tuples."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(data) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def jaccard(rows):
    """(doc_id, n_shingles, component_id)"""
    sets = []
    for doc, text in rows:
        w = SPACED.findall(lower(text))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    shared = Counter()
    for h in holders.values():
        for j in range(len(h)):
            for k in range(j):
                shared[h[k], h[j]] += 1
    for (i, j), n in shared.items():
        if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
            parent[root(j)] = root(i)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), doc), doc)
    return [(doc, len(sets[i]), least[root(i)]) for i, (doc, _) in enumerate(rows)]


def license_base(rows, phrases):
    """(doc_id, n_words, n_base, first_word, last_word, base_labels)"""
    out = []
    for doc, text in rows:
        w = ALNUM.findall(lower(text))
        at, labels = [], set()
        for phrase, label in phrases.items():
            p = phrase.split()
            hits = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
            at += hits
            labels |= {label} if hits else set()
        out.append((doc, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))))
    return out


def contamination(rows, items):
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)"""
    windows = defaultdict(set)
    for item, text in items:
        w = ALNUM.findall(lower(text))
        for i in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[i : i + 13])].add(str(item))
    lengths = sorted({len(w) for w in windows})
    out = []
    for doc, text in rows:
        w = ALNUM.findall(lower(text))
        hit, met = set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                found = windows.get(tuple(w[i : i + n]))
                if found:
                    met |= found
                    hit.update(range(i, i + n))
        out.append((doc, len(w), len(hit), len(met), sha(",".join(sorted(met))), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def byte_dedup(rows, n=50):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256)"""
    first = {}
    raw = [(doc, (text or "").encode()) for doc, text in rows]
    for doc, b in raw:
        for i in range(len(b) - n + 1):
            s = b[i : i + n]
            if first.get(s, doc) >= doc:
                first[s] = doc
    out = []
    for doc, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if first[b[i : i + n]] < doc:
                gone[i : i + n] = b"\x01" * n
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc, len(b), len(b) - len(kept), spans, sha(kept)))
    return out


def word_dedup(rows, n=35):
    """(doc_id, n_words, n_removed, kept_sha256)"""
    words = [(doc, SPACED.findall(text or "")) for doc, text in rows]
    seen = Counter(tuple(w[i : i + n]) for _, w in words for i in range(len(w) - n + 1))
    out = []
    for doc, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                gone[i : i + n] = [True] * n
        out.append((doc, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def unigram_scores(rows):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score)"""
    tokens = [(doc, [*SPACED.findall(lower(text)), None]) for doc, text in rows]
    counts = Counter(t for doc, w in tokens if fold(doc, 7) != 2 for t in w)
    total = sum(counts.values())
    below = total + len(counts) + 1
    return [
        (doc, fold(doc, 7) == 2, len(w), sum(counts[t] > 0 for t in w), total, sum(math.log10((counts[t] + 1) / below) for t in w))
        for doc, w in tokens
    ]


def luhn(digits):
    d = [int(c) for c in digits[::-1]]
    return sum(d[0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])


def personal(rows):
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256)"""
    out = []
    for doc, text in rows:
        text = text or ""
        found = {
            "email": list(re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)),
            "ip": [m for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))],
            "card": [],
            "phone": [m for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.findall("[0-9]", m.group())) <= 15],
        }
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
            digits = re.sub("[ -]", "", m.group())
            if 13 <= len(digits) <= 19 and luhn(digits) % 10 == 0:
                found["card"].append(m)
        spans = ",".join(f"{k}:{m.start()}:{m.end()}" for k, ms in found.items() for m in ms)
        out.append((doc, *[len(ms) for ms in found.values()], sha(spans)))
    return out


def alignment(rows, path_a, path_b):
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)"""
    import sentencepiece
    from tokenizers import Tokenizer

    lib_a, lib_b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
    lib_a.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}

    def bytes_b(i):
        p = lib_b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()

    docs, counts = [], Counter()
    for doc, text in rows:
        whole = (" " + (text or "")).encode()
        a = lib_a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = lib_b.encode(text) if text else []
        parts_a = [bytes(letter[c] for c in lib_a.id_to_token(i)) for i in a]
        parts_b = [bytes_b(i) for i in b]
        if b"".join(parts_a) != whole or b"".join(parts_b) != whole:
            a = b = parts_a = parts_b = []
        owner = lambda parts: [i for i, p in enumerate(parts) for _ in p]
        links = {(i, j) for i, j in zip(owner(parts_a), owner(parts_b))}
        ends = _running
        end_a, end_b = ends(parts_a), ends(parts_b)
        groups, x, y = [], 0, 0
        for e in sorted(set(end_a) & set(end_b)):
            nx, ny = end_a.index(e, x) + 1, end_b.index(e, y) + 1
            groups.append(",".join(map(str, a[x:nx])) + "|" + ",".join(map(str, b[y:ny])))
            x, y = nx, ny
        linked = [(a[i], b[j]) for i, j in links]
        counts.update(set(linked))
        docs.append((doc, len(a), len(b), groups, linked))
    best = {}
    for (i, _), n in counts.items():
        best[i] = max(best.get(i, 0), n)
    return [
        (doc, na, nb, len(g), len(ls), sum(counts[p] == best[p[0]] for p in ls), sum(counts[p] for p in ls), sha(";".join(g)) if na else "")
        for doc, na, nb, g, ls in docs
    ]


def _running(parts):
    out, n = [], 0
    for p in parts:
        n += len(p)
        out.append(n)
    return out


def phrases(rows, minimum=10, absorb=50, top=2000):
    """(lang, rank, phrase, a, l, r, n, score); rows are (lang, text)"""
    held, words = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(w)
            held[lang].update(tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    out = []
    for lang, c in held.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= minimum}
        gone = {q for p, a in found.items() if len(p) == 3 for q in (p[:2], p[1:]) if 100 * a >= absorb * found[q]}
        listed = []
        for p, a in found.items():
            if p not in gone:
                score, k = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                listed.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(listed)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, words[lang], -s))
    return out
