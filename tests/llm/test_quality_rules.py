import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from querysmith.llm import quality_rules as q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dups, len(covered), n < 10 or 100 * len(covered) > 20 * n


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n\t\x85 é#|", max_size=300))
def test_counts(text):
    assert q.judge(text)[:6] == brute(text)


def test_many_distinct_words():
    text = " ".join(f"w{i}" for i in range(9000)) + " " + " ".join(f"w{i}" for i in range(40))
    assert q.judge(text)[:6] == brute(text)


def test_verdicts():
    prose = "The quick brown fox jumps over the lazy dog near the river bank.\nA second line of plain prose follows it here, and ends well."
    assert q.judge(prose)[6]
    assert not q.judge("A### b$$$ c%%% d&&& e*** f### g$$$ h%%% i&&& j*** k### l$$$")[6]
    assert not q.judge("Home | About | News | Contact | Shop | Help | Login | Search | More | Blog | Jobs | Press")[6]
    assert not q.judge("BUY!! NOW!! CHEAP!! PILLS!! TODAY!! ONLY!! HERE!! AND!! NOW!! GO!! ON!! IT!!")[6]
    mixed = q.judge(prose + "\nHome | About | News | Contact")
    assert mixed[6] and mixed[7] == prose and mixed[8] == 1


def test_operator(spark):
    rows = [(1, None, "a", 5), (2, "", None, None), (3, "word " * 9, "x", 1), (3, "word " * 9, "x", 1), (None, "Plain words that make up a sentence of more than ten words here.", "y", 2), (5, "long words and more of them " * 20000, "z", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words int")
    out = q.apply_rules(df).collect()
    assert len(out) == 6 and out[0].asDict()["kept"] == "a"
    by = {(r.doc_id, r.text if r.text is None else r.text[:5]): r.quality for r in out}
    assert by[(1, None)].base_failed and not by[(1, None)].kept and by[(1, None)].clean_text == ""
    assert by[(None, "Plain")].kept and by[(3, "word ")].n_words == 9 and by[(5, "long ")].base_failed
    assert q.apply_rules(df.limit(0)).count() == 0
