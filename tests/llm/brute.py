"""Plain versions of the operators, for tests."""

import hashlib
import re

import xxhash

KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    odd = [int(d) for d in digits[::-1]]
    return sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(odd)) % 10 == 0


def pii(text):
    """(kind, start, stop) of the base kinds, by kind, then start."""
    out = []
    for kind, pattern in KINDS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda: 13 <= len(digits) <= 19 and luhn(digits),
                "phone": lambda: 9 <= len(digits) <= 15,
            }[kind]()
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, linked):
    """The smallest node reachable from each."""
    label = {}
    for n in sorted(nodes):
        if n in label:
            continue
        label[n], todo = n, [n]
        while todo:
            a = todo.pop()
            for b in nodes:
                if b not in label and linked(a, b):
                    label[b] = n
                    todo.append(b)
    return label


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))


def contamination(text, items):
    words, hit, found = words_of(text), set(), set()
    for item, item_text in items:
        w = words_of(item_text)
        for k in range(max(1, len(w) - 12) if w else 0):
            window = w[k : k + 13]
            for s in range(len(words) - len(window) + 1):
                if words[s : s + len(window)] == window:
                    hit |= set(range(s, s + len(window)))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)
