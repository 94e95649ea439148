"""Small documents with all the odd cases, and plain versions of what operators work on."""

import hashlib
import random
import re

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    # Names that operators use for columns of their own.
    "size long, kept string, score double, doc string, length long, component_id long, key string, block int"
)
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").encode())


def sha(data):
    return hashlib.sha256(data).hexdigest()


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def documents(spark, copies=6):
    """Near and exact copies, shared lines and passages, NULLs, blanks, other white space, a long text, equal rows."""
    rng = random.Random(7)
    passage = sentence(rng, 30)
    line = "A line that many documents have."
    texts = [sentence(rng, n) for n in (3, 5, 19, 20, 21, 80, 200)]
    base = sentence(rng, 150)
    for i in range(copies):
        changed = base.split()
        changed[i * 7] = f"new{i}"
        texts.append(" ".join(changed))
    texts += [base, base, base.upper()]
    texts += [f"{sentence(rng, 12)}\n{line}\n{passage} {sentence(rng, 9)}\n  a LINE that many documents have.\t" for _ in range(4)]
    texts += [f"{passage}\n{passage}", "the " * 60, "No.\nNo.\nshort", "", " \n\t ", None, "a b c d　e f", "ÄÉ straße\n" * 3]
    texts += [sentence(rng, 30_000, 5_000), "\n".join(sentence(rng, 6) for _ in range(40)), "12 34 56, 78.", "x" * 50_000]
    texts += [f"{passage} {sentence(rng, 40)}".replace(" ", "  \r\n\x0b\x0c"), "café <|endoftext|> don't 12345   x \n\n y", "\U0001f600 你好 مرحبا"]
    rows = [
        (i * 3 + 1, t, (None, "en", "de")[i % 3], (None, "a", "b", "ä")[i % 4], len(t or ""), 1, "x", 0.5, "d", 1, 2, "k", 3)
        for i, t in enumerate(texts)
    ]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def roots(nodes, links):
    """The smallest node that each node reaches."""
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {n: find(n) for n in nodes}
