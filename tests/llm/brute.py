"""Plain re-statements of the operators' contracts, for small inputs."""

import hashlib
import re
import zlib

import numpy as np


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def base_spans(text):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    out.sort()
    names = ("assign", "access", "hex")
    return [sum(k == j for _, k, _ in out) for j in range(3)], ",".join(f"{names[k]}:{s}:{e}" for s, k, e in out)


def decontaminated(docs, benchmark):
    word, windows = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), {}
    for item, text in benchmark:
        ws = word.findall(lower(text or ""))
        for k in range(max(1, len(ws) - 12) if ws else 0):
            windows.setdefault(tuple(ws[k : k + 13]), set()).add(item)
    out = []
    for doc, text in docs:
        ws, hit, items = word.findall(lower(text or "")), set(), set()
        for w, own in windows.items():
            for k in range(len(ws) - len(w) + 1):
                if tuple(ws[k : k + len(w)]) == w:
                    hit.update(range(k, k + len(w)))
                    items |= own
        items = sorted(str(i) for i in items if i is not None)
        out.append((doc, len(ws), len(hit), len(items), sha(",".join(items)), bool(hit) and 20 * len(hit) >= len(ws)))
    return out


def repeats(docs, length, units):
    """(doc, symbols, mask of removed symbols): windows that also start in a smaller document."""
    first, own = {}, []
    for doc, text in docs:
        symbols = units(text or "")
        key = float("inf") if doc is None else doc
        own.append((doc, key, symbols))
        for k in range(len(symbols) - length + 1):
            w = tuple(symbols[k : k + length])
            first[w] = min(first.get(w, key), key)
    for doc, key, symbols in own:
        mask = [False] * len(symbols)
        for k in range(len(symbols) - length + 1):
            if first[tuple(symbols[k : k + length])] < key:
                mask[k : k + length] = [True] * length
        yield doc, symbols, mask


def byte_repeats(docs):
    out = []
    for doc, symbols, mask in repeats(docs, 50, lambda t: list(t.encode())):
        spans = sum(m and (k == 0 or not mask[k - 1]) for k, m in enumerate(mask))
        out.append((doc, len(symbols), sum(mask), spans, sha(bytes(s for s, m in zip(symbols, mask, strict=True) if not m))))
    return out


def word_repeats(docs):
    return [(doc, len(s), sum(m), sha(" ".join(w for w, x in zip(s, m, strict=True) if not x))) for doc, s, m in repeats(docs, 50, lambda t: re.findall(r"[^\x20\x09-\x0D]+", t))]


def jaccard_classes(docs, n=3, percent=90):
    sets = {}
    for row, (doc, text) in enumerate(docs):
        ws = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
        sets[row] = {tuple(ws[k : k + n]) for k in range(len(ws) - n + 1)} if len(ws) >= n else {tuple(ws)} if ws else set()
    parent = {doc: doc for doc, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, sa in sets.items():
        for b, sb in sets.items():
            if a < b and sa and sb and 100 * len(sa & sb) >= percent * len(sa | sb):
                x, y = find(docs[a][0]), find(docs[b][0])
                if x != y:
                    parent[max(x, y)] = min(x, y)
    return [(doc, len(sets[row]), find(doc)) for row, (doc, _) in enumerate(docs)]


def tokens(tokenizer, text, end):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())
