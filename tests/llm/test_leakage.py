import numpy as np
import pytest

from gridloom.llm import leakage as lk
from gridloom.llm.typeset import words

PASSAGE = "the quick brown fox jumps over the lazy dog while seven clever cats watch from a warm roof"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (r"The \emph{quick} {\bf brown} \textbf{fox}~jumps\index{fox} over~\cite[p.~3]{key} the", "the quick brown fox jumps over the"),
        ("resam-\npled ap\\-parent", "resampled apparent"), ("% one two\n% three", "one two three"), ("one%\n  two", "onetwo"), (r"caf\'e na\"{\i}ve \c{c}a stra\ss e", "café naïve ça strasse"),
        ("cafe\u0301 zero\u200bwidth so\u00adft", "café zerowidth soft"), (r"\newcommand{\XY}{while} a \XY{} b", "a while b"), (r"\def\XY{while} a \XY b", "a while b"), ("A\r\nB", "a b"),
        (r"\section{Title Words}\label{sec:x} text", "title words text"), (r"end.\footnote{Note here.} next", "end note here next"), (r"\item one \item two", "one two"), (None, ""), ("", ""), ("x_1 2.5", "x 1 2 5"),
    ],
)
def test_words(text, want):
    assert words(text) == want.split()


def test_long_and_nested_macros():
    long = "".join(f"\\newcommand{{\\W{a}}}{{{w} {PASSAGE}}}" for a, w in zip("abcd", ("one", "two", "three", "four")))
    assert words(long + r"\Wa{} \Wb{} \Wc{} \Wd{} " * 40) == [x for w in ("one", "two", "three", "four") for x in (w, *PASSAGE.split())] * 40
    names = "abcdefghij"
    chain = "".join(f"\\def\\N{a}{{{w} \\N{b}}}" for a, b, w in zip(names, names[1:], PASSAGE.split())) + r"\def\Nj{end}"
    assert words(chain + r"so \Na.") == ["so", *PASSAGE.split()[:9], "end"]
    deep = "".join(f"\\newcommand{{\\D{'a' * i}}}{{\\D{'a' * (i + 1)}}}" for i in range(1, 300)) + f"\\newcommand{{\\D{'a' * 300}}}{{core}}"
    assert words(deep + r"the \Da{} part") == ["the", "core", "part"]
    assert words(r"\def\A{one \B}\def\B{two \A} start \A{} stop") == ["start", "one", "two", "stop"]
    assert words(r"\def\A{one \A} start \A stop") == ["start", "one", "stop"]
    double = "".join(f"\\def\\L{a}{{\\L{b}\\L{b}}}" for a, b in zip("abcdefghijklmnopqrstuvwxyz", "bcdefghijklmnopqrstuvwxyzA")) + r"\def\LA{ha }"
    assert words(double + r"\La") and words(double + r"\Lw, end") == ["ha"] * 16 + ["end"]


def brute(docs, items, run):
    out = set()
    for d, t in docs:
        ws = words(t)
        seen = {tuple(ws[i : i + run]) for i in range(len(ws) - run + 1)}
        for k, p in items:
            ps = words(p)
            if any(tuple(ps[i : i + run]) in seen for i in range(len(ps) - run + 1)):
                out.add((d, k))
    return out


def test_like_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(i, text(30)) for i in range(15)] + [(90, PASSAGE), (91, PASSAGE + " and more words"), (92, None), (93, ""), (94, "too short"), (95, "same " * 40)]
    docs = [(i, text(60)) for i in range(30)] + [(200, None), (201, ""), (202, "same " * 12), (203, "same " * 11), (204, PASSAGE.upper()), (204, PASSAGE)]
    for i in range(25):
        ws = words(items[i % 15][1])
        n, at = int(rng.integers(9, 16)), int(rng.integers(0, 14))
        docs.append((100 + i, f"{text(8)} {' '.join(ws[at : at + n])} {text(8)}"))
    docs.append((300, "filler " * 50_000 + PASSAGE))
    a = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items, 12)
    assert {tuple(r) for r in lk.leaks(a, "doc_id", "text", b, "item_id", "text").collect()} == want
    monkeypatch.setattr(lk, "BLOCK_WORDS", 60)
    assert {tuple(r) for r in lk.leaks(a, "doc_id", "text", b, "item_id", "text").collect()} == want


def test_empty_and_equal_names(spark):
    a = spark.createDataFrame([(1, PASSAGE)], "id long, text string")
    assert lk.leaks(a.limit(0), "id", "text", a, "id", "text").columns == ["id", "id_item"]
    assert lk.leaks(a.limit(0), "id", "text", a, "id", "text").count() == 0
    assert lk.leaks(a, "id", "text", a.limit(0), "id", "text").count() == 0
    assert [tuple(r) for r in lk.leaks(a, "id", "text", a, "id", "text").collect()] == [(1, 1)]
