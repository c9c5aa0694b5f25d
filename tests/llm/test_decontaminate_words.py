"""Decontamination of words whose case mapping hangs on their neighbours, against plain windows."""

import random
import re

from offerloom.llm import decontaminate


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def windows(text):
    w = words(text)
    n = min(13, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()


def plain(text, items):
    w, hit, found = words(text), set(), []
    for item, wanted in items.items():
        places = {p for v in wanted for i in range(len(w) - len(v) + 1) if tuple(w[i : i + len(v)]) == v for p in range(i, i + len(v))}
        hit |= places
        found += [item] if places else []
    return len(w), len(hit), len(found), bool(hit) and 20 * len(hit) >= len(w)


def test_words_have_one_form(spark):
    drawn = random.Random(12)
    endings = ["ΟΔΟΣ", "οδος", "οδοΣ", "ΛΌΓΟΣ", "İstanbul", "ISTANBUL", "ıI", "Kelvin", "KELVIN", "ß", "SS", "ǅ", "ﬁn", "Ⅷ", "x1"]
    gaps = [" ", ".", ":", "'", " - ", "\n", "\u0000", "·", "’"]

    def text(chosen):
        return "".join(w + drawn.choice(gaps) for w in chosen)

    sequences = [[drawn.choice(endings) + str(drawn.randint(0, 9)) * drawn.randint(0, 1) for _ in range(n)] for n in (15, 13, 30, 5, 1, 20)]
    items = [(i, text(s)) for i, s in enumerate(sequences)] + [(90, None), (91, "...")]
    documents = [(i, text(s)) for i, s in enumerate(sequences * 6)]
    documents += [(100 + i, text(drawn.choices(endings, k=40) + sequences[i % 3])) for i in range(12)]
    documents += [(200, " ".join(["ΟΔΟΣ"] * 15)), (201, ".".join(["ΟΔΟΣ"] * 15)), (202, None), (203, "")]
    items.append((92, " ".join(["ΟΔΟΣ"] * 15)))
    wanted = {i: windows(t) for i, t in items}
    got = decontaminate.contamination(
        spark.createDataFrame(documents, "doc_id bigint, text string").repartition(3),
        spark.createDataFrame(items, "item_id bigint, text string"),
    ).collect()
    for r in got:
        expected = plain(dict(documents)[r["doc_id"]], wanted)
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == expected, r
    assert {r["doc_id"]: r["n_hit"] for r in got}[201] == 15
