"""Substring deduplication against brute force that splits and compares texts in its own way."""

import random
import re
import zlib

import pyarrow as pa
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import substring

SCHEMA = "doc_id long, text string"
WORD = re.compile(r"[^ \t\n\r\x0b\x0c]+")


def split(text):
    """(start, words) of each sentence of a text whose words are short and divided by spaces."""
    out, words = [], list(WORD.finditer(text))
    sentence = []
    for k, m in enumerate(words):
        sentence.append(m)
        gap = text[m.end() : words[k + 1].start() if k + 1 < len(words) else len(text)]
        if m[0][-1] in ".!?" or "\n" in gap or k == len(words) - 1:
            behind = set()
            if len(sentence) > substring.LONG:
                rank = [int.from_bytes(xxhash.xxh3_128_digest(w[0].lower().encode())[:8], "little") for w in sentence]
                for a in range(len(rank) - substring.WINDOW + 1):
                    window = rank[a : a + substring.WINDOW]
                    behind.add(a + max(j for j, r in enumerate(window) if r == min(window)))
            part = []
            for j, w in enumerate(sentence):
                part.append(w)
                if j in behind or j == len(sentence) - 1:
                    out.append((part[0].start() if out else 0, [x[0].lower() for x in part]))
                    part = []
            sentence = []
    return out


def brute(rows):
    """Every run of every length is compared, not only the shortest ones."""
    seen, out = {}, []
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    parts = {k: split(rows[k][1] or "") for k in order}
    gone = {k: set() for k in order}
    for k in order:
        for a in range(len(parts[k])):
            for b in range(a + substring.SENTENCES, len(parts[k]) + 1):
                words = [w for _, ws in parts[k][a:b] for w in ws]
                if len(words) >= substring.LEAST_WORDS:
                    places = seen.setdefault(" ".join(words), [])
                    if places:
                        gone[k] |= set(range(a, b))
                    places.append((k, a))
    for k, (i, t) in enumerate(rows):
        edges = [s for s, _ in parts[k]] + [len(t or "")]
        kept = "".join((t or "")[edges[j] : edges[j + 1]] for j in range(len(parts[k])) if j not in gone[k]) if parts[k] else t
        out.append((i, kept, len(gone[k]), sum(len(parts[k][j][1]) for j in gone[k])))
    return out


def cleaned(spark, rows, schema=SCHEMA):
    return sorted((tuple(r) for r in substring.remove_repeats(spark.createDataFrame(rows, schema).coalesce(1)).collect()), key=lambda r: (r[0] is None, r[0] or 0, str(r)))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(" ab.!?\nÉ\t", max_size=60), max_size=5))
def test_units_match_a_plain_splitter(texts):
    found = substring.units(pa.array(texts, pa.large_string()))
    got = [[] for _ in texts]
    for k, doc in enumerate(found.doc):
        text = texts[doc].encode()
        stop = found.start[k + 1] if k + 1 < len(found.doc) and found.doc[k + 1] == doc else len(text)
        got[doc].append((len(text[: found.start[k]].decode()), text[found.start[k] : stop].decode().lower().split(), found.word[k + 1] - found.word[k]))
    assert got == [[(s, w, len(w)) for s, w in split(t)] for t in texts]


def test_matches_brute_force(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
    sentence = lambda: " ".join(word() for _ in range(rng.choice([1, 2, 5, 12, 20, 35]))).capitalize() + rng.choice([". ", "! ", ".\n", "\n"])
    passages = ["".join(sentence() for _ in range(6)) for _ in range(4)]
    texts = ["".join(sentence() for _ in range(5)) + rng.choice([*passages, ""]) + "".join(sentence() for _ in range(3)) for _ in range(40)]
    texts += [texts[3], texts[4].upper(), passages[0] * 3, None, "", "  ", "one word", "Er. Er.", "Er. Er.", "same " * 60, "x | " * 50, " \n" + texts[6]]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    assert sorted(cleaned(spark, rows)) == sorted(brute(rows))


def test_short_sentences_at_either_end(spark):
    for sizes in ([20, 1, 1, 1], [1, 1, 1, 20], [10, 1, 10], [1, 9, 1, 9, 1]):
        passage = " ".join(" ".join(f"w{k}x{j}" for j in range(n)) + "." for k, n in enumerate(sizes))
        rows = [(1, f"Own words one. {passage} Other ends here."), (2, f"Quite different start. {passage} And a tail.")]
        got = cleaned(spark, rows)
        assert got == brute(rows) and got[1][1] == "Quite different start. And a tail." and got[1][3] == sum(sizes)


def test_repeated_null_and_mixed_ids(spark):
    p = "One two three four five six seven eight nine ten. Eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen. "
    u = "Alone one two three four five six seven eight. Never anywhere else do these nine words here stand again. "
    rows = [(None, p), (1, p), (5, p + "Tail."), (5, u + "Tail."), (None, p), (1, p), (5, p + u), (None, u), (7, None), (7, ""), (None, None)]
    got = cleaned(spark, rows)
    assert sorted(map(str, got)) == sorted(map(str, brute(rows)))
    assert sum(p in (t or "") for _, t, _, _ in got) == 1 and (1, p, 0, 0) in got and (5, u + "Tail.", 0, 0) in got
    assert cleaned(spark, []) == []
    assert len(cleaned(spark, [(1, p, 1), (2, p, 2)], SCHEMA + ", gone int")) == 2


def test_a_shared_line_of_few_words_stays(spark):
    line = "All rights are kept by those who wrote this. Do not copy it.\n"
    rows = [(k, f"{line}Text {k} goes on for itself with number {k * 7} and says {k * 11} more.") for k in range(6)]
    assert [t for _, t, _, _ in cleaned(spark, rows)] == [t for _, t in rows]


def test_a_very_long_text_and_one_group_of_many(spark):
    rng = random.Random(5)
    long = " ".join(str(rng.randrange(10**6)) for _ in range(400_000))
    passage = " ".join(f"p{k}" for k in range(60)) + ". And it ends here."
    rows = [(1, long), (2, "short"), *((10 + k, f"Unique {k} begins here. {passage}") for k in range(500))]
    got = dict((i, t) for i, t, _, _ in cleaned(spark, rows))
    assert got[1] == long and got[10] == rows[2][1] and all(len(got[10 + k]) < 60 for k in range(1, 500))
    assert zlib.crc32(got[1].encode()) == zlib.crc32(long.encode())
