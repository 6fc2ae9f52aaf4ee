"""Plain twins of the operators, for small tables, and a table of awkward documents."""

import hashlib
import re

import numpy as np
import xxhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, dest int, kind int, score double, key string"
WORD = r"[^\x20\x09-\x0D]+"
LATIN = "the quick brown fox jumps over the lazy dog while seven wizards mix a pale green potion by the river".split()


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(f"{LATIN[i]}{j}" for i, j in zip(rng.integers(0, len(LATIN), n), rng.integers(0, 40, n)))


def awkward():
    """Nulls, blanks, copies, ties, repeats inside one text, long words, wide characters, repeated rows and ids."""
    shared = prose(1, 60)
    texts = {
        1: shared, 2: prose(2, 30) + " " + shared + "\n" + prose(3, 20), 3: shared, 4: "", 5: None, 6: " \t\n ",
        7: "a" * 450, 8: "ab" * 300 + " tail", 9: prose(4, 200) + " " + prose(4, 200), 10: "é" * 130 + " ñ",
        11: "x" * 100, 12: "x" * 99, 13: prose(2, 30) + " other words " + prose(3, 20), 14: "one", 15: "one two",
        16: "One  TWO", 17: shared.upper(), 18: prose(5, 3000), 19: " ".join(prose(5, 3000).split()[:1500]), 20: "\x00\x01 \x0b odd\x85bytes\xa0here",
    }
    rows = [(i, t, "en", f"s{i % 4}" if i % 5 else None, None, 1, 2, 0.5, "k") for i, t in texts.items()]
    rows += [rows[0], rows[0], (1, "another text under a known id", None, None, 3, None, None, None, None)]
    return [*rows, (None, shared, "en", "s0", 1, 0, 0, 0.0, ""), (None, None, None, None, None, None, None, None, None)]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def order(doc_id):
    return (doc_id is None, doc_id or 0)


def windows(rows):
    """op10: (doc_id, words, removed, digest) of each row."""
    least, out = {}, []
    split = [(i, re.findall(WORD, t or "")) for i, t in rows]
    for i, words in split:
        for k in range(len(words) - 12):
            run = tuple(words[k : k + 13])
            least[run] = min(least.get(run, order(i)), order(i))
    for i, words in split:
        gone = {j for k in range(len(words) - 12) if least[tuple(words[k : k + 13])] < order(i) for j in range(k, k + 13)}
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def strings(rows, tie):
    """op3: (doc_id, bytes, removed, spans, digest) of each row; ``tie`` orders rows of one id."""
    least, out = {}, []
    for i, t in rows:
        data = (t or "").encode()
        for k in range(len(data) - 99):
            at = (*order(i), tie(i, t), k)
            least[data[k : k + 100]] = min(least.get(data[k : k + 100], at), at)
    for i, t in rows:
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for k in range(len(data) - 99):
            if least[data[k : k + 100]] < (*order(i), tie(i, t), k):
                gone[k : k + 100] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        out.append((i, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def fingerprint(text):
    words = re.findall(WORD, lower(text or ""))
    if not words:
        return 0
    runs = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def classes(n, linked):
    """Smallest index reachable from each of n points."""
    root = list(range(n))
    for _ in range(n):
        before = list(root)
        for a, b in linked:
            root[a] = root[b] = min(root[a], root[b])
        if before == root:
            return root
    return root


def contamination(rows, items):
    """op7: (doc_id, words, hit, items, digest, verdict) of each row."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    held = {}
    for item, text in items:
        words = re.findall(word, lower(text or ""))
        for k in range(max(1, len(words) - 12) if words else 0):
            held.setdefault(tuple(words[k : k + 13]), set()).add(str(item))
    out = []
    for i, text in rows:
        words, hit, met = re.findall(word, lower(text or "")), set(), set()
        for size in {len(k) for k in held}:
            for k in range(len(words) - size + 1):
                if found := held.get(tuple(words[k : k + size])):
                    hit |= set(range(k, k + size))
                    met |= found
        digest = hashlib.sha256(",".join(sorted(met)).encode()).hexdigest()
        out.append((i, len(words), len(hit), len(met), digest, bool(hit) and 20 * len(hit) >= len(words)))
    return out


def luhn(digits):
    values = [int(c) for c in reversed(digits)]
    return sum(v if k % 2 == 0 else sum(divmod(2 * v, 10)) for k, v in enumerate(values)) % 10 == 0


def personal(text):
    """op2: base spans by kind, by the plain patterns."""
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    email = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    ip = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    card = [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    phone = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m)) <= 15]
    return {"email": email, "ip": ip, "card": card, "phone": phone}
