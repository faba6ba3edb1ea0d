"""Small corpora and brute-force definitions shared by the tests."""

import hashlib
import random
import re

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def corpus(seed=1, n=60):
    """Random documents with shared passages, near copies, copies, nulls and odd texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["Ärger", "Ñandú", "été", "日本語", "ß"]
    make = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passages = [make(60), make(120)]
    texts = [None, "", " \t\n ", "one", "one two", "a b c d e", "A B C D E", "und " * 300, "x\x00y \x0b z", "é" * 3000]
    for i in range(n):
        words = make(rng.choice([3, 20, 60, 150, 400]))
        if i % 5 == 0:
            at = rng.randrange(len(words) + 1)
            p = passages[i % 2]
            cut = rng.randrange(20)
            words = [*words[:at], *p[cut:], *words[at:]]
        texts.append(rng.choice([" ", "\n", "  "]).join(words))
    for i in range(n // 3):
        words = (rng.choice(texts[10:]) or "").split()
        for _ in range(rng.choice([0, 1, 2])):
            if words:
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts.append(" ".join(words))
    texts.append(" ".join(make(20_000)))
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["src0", "src3", "src12", None]), len(t or ""), "x") for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


def rows_of(frame, *columns):
    return sorted(tuple(r[c] for c in columns) for r in frame.select(*columns).collect())
