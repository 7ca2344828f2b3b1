"""Plain versions of the operators over {id: text}, straight from their contracts."""

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile("[^\x20\x09-\x0d]+")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def lower(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def substring(docs, width=20):
    words = {d: WORD.findall(t or "") for d, t in docs.items()}
    seen, gone = set(), defaultdict(set)
    for d in sorted(words):
        for k in range(len(words[d]) - width + 1):
            w = tuple(words[d][k : k + width])
            if w in seen:
                gone[d].update(range(k, k + width))
            seen.add(w)
    return {(d, len(w), len(gone[d]), sha(" ".join(x for k, x in enumerate(w) if k not in gone[d]))) for d, w in words.items()}


def suffix(docs, width=100):
    out, seen = set(), set()
    for d in sorted(docs):
        b = (docs[d] or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            s = b[k : k + width]
            if s in seen:
                gone[k : k + width] = b"\1" * width
            seen.add(s)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.add((d, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    return out


def lines(docs):
    key = lambda x: lower(x.strip(" \t\n\r\x0b\x0c"))
    held = defaultdict(set)
    for d, t in docs.items():
        for x in (t or "").split("\n"):
            held[key(x)].add(d)
    out = set()
    for d, t in docs.items():
        all_ = (t or "").split("\n")
        kept = [x for x in all_ if len(key(x)) < 20 or len(held[key(x)]) < 3 or max(held[key(x)]) == d]
        out.add((d, len(all_), len(all_) - len(kept), sha("\n".join(kept))))
    return out


def fingerprint(text, width=3):
    w = WORD.findall(lower(text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[k : k + width]) for k in range(max(1, len(w) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash(docs, reach=2):
    prints = {d: fingerprint(t) for d, t in docs.items()}
    distinct = sorted(set(prints.values()))
    up = {f: f for f in distinct}

    def find(f):
        while up[f] != f:
            f = up[f]
        return f

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= reach:
                up[find(a)] = find(b)
    least = {}
    for d in sorted(docs):
        least.setdefault(find(prints[d]), d)
    return {(d, f"{prints[d]:016x}", least[find(prints[d])]) for d in docs}


def measures(text):
    text = text or ""
    w = WORD.findall(text)
    count = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
    covered = set()
    for j in range(len(w) - 2):
        if count[tuple(w[j : j + 3])] > 1:
            covered.update((j, j + 1, j + 2))
    held = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(held) - len(set(held)), len(covered)


def conversations(rows, learn="assistant"):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = set()
    for conv, turns in by.items():
        turns = [t[2:] for t in sorted(turns)]
        loss = "".join(x for r, x in turns if r == learn)
        out.add((conv, len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(loss), sha(loss)))
    return out
