"""Main texts: the suffix array over all pages of a host, whether they mark their article or not."""

import numpy as np
import pytest

from sablelens.llm import html_text as pages
from tests.llm.conftest import prose

SCHEMA = "page_id long, url string, html string"


def texts(spark, rows, **more):
    return {r["page_id"]: r["text"] for r in pages.main_text(spark.createDataFrame(rows, SCHEMA), **more).collect()}


@pytest.mark.parametrize("bundle", [1, 2, 64])
def test_marked_pages_lose_repeats_beside_their_article(spark, bundle):
    """Hosts of marked pages alone: teasers and chrome of main go, an article keeps the lines that it shares with others."""
    teaser = f"<article><h2>{prose(900, 4)}</h2><p>{prose(901, 8)}</p></article>"
    chrome = "<div>Home News Sport Weather Contact About us today</div>"
    line = "All of this is published under the license of the house"
    rows = [(k, f"https://a.example.com/{k}", f"<body><main>{chrome}<article><p>{prose(k, 30)}</p><p>{line}</p></article>{teaser}</main></body>") for k in range(5)]
    rows += [(10 + k, f"https://b.example.com/{k}", f"<body><main>{chrome}<article><p>{prose(k, 30)}</p></article>{teaser}</main></body>") for k in range(2)]
    got = texts(spark, rows, bundle=bundle)
    assert {k: got[k] for k in range(5)} == {k: f"{prose(k, 30)} {line}" for k in range(5)}
    assert got[10].startswith("Home News") and got[10].endswith(prose(901, 8)), "two pages are no repeat"


def test_a_repeated_article_stays(spark):
    """Three pages of one article, beside a card of their own, and three in main alone."""
    rows = [(k, f"https://a.example.com/{k}", f"<article><p>{prose(1, 40)}</p></article><article>{prose(50 + k, 9)}</article>") for k in range(3)]
    rows += [(10 + k, f"https://b.example.com/{k}", f"<main><p>{prose(2, 40)}</p><p>{prose(60 + k, 9)}</p></main>") for k in range(3)]
    want = {k: f"{prose(1, 40)} {prose(50 + k, 9)}" for k in range(3)} | {10 + k: f"{prose(2, 40)} {prose(60 + k, 9)}" for k in range(3)}
    assert texts(spark, rows) == want


@pytest.mark.parametrize("told", [1 << 25, 30])
@pytest.mark.parametrize("bundle", [1, 7, 4096])
def test_repeats_of_hosts_against_brute_force(spark, monkeypatch, bundle, told):
    """Undecided pages of few words, with copies, of hosts of 1 to 200 pages; however large the pieces and the rounds."""
    monkeypatch.setattr(pages, "TOLD", told)
    rounds, repeated = [], pages._repeated
    monkeypatch.setattr(pages, "_repeated", lambda *a: rounds.append(1) or repeated(*a))
    rng, rows = np.random.default_rng(5), []
    for host, n in enumerate((1, 2, 3, 40, 200)):
        for _ in range(n):
            words = [f"w{x}" for x in rng.integers(0, 6, rng.integers(0, 40))]
            rows.append((len(rows), f"https://h{host}.example.com/{len(rows)}", " ".join(words)))
            if rng.random() < 0.3:
                rows.append((len(rows), f"https://h{host}.example.com/copy", rows[-1][2]))
    where: dict = {}
    for _, url, text in rows:
        w = text.split()
        for k in range(len(w) - 5):
            where.setdefault((url.split("/")[2], *w[k : k + 6]), set()).add(text)
    want = {}
    for i, url, text in rows:
        w = text.split()
        gone = {j for k in range(len(w) - 5) if len(where[(url.split("/")[2], *w[k : k + 6])]) >= 3 for j in range(k, k + 6)}
        want[i] = " ".join(x for j, x in enumerate(w) if j not in gone)
    assert any(len(want[i]) < len(t) for i, _, t in rows)
    assert texts(spark, rows, bundle=bundle) == want
    assert (len(rounds) > 1) == (told == 30)


def test_packed_hashes():
    rng = np.random.default_rng(6)
    for values in ([], [0], [2**64 - 1], [0, 2**64 - 1], rng.integers(0, 2**63, 1000), rng.integers(0, 2**20, 1000), [5, 5, 5]):
        some = np.sort(np.array(values, np.uint64))
        assert (pages.unpacked(pages.packed(some)) == some).all()


def test_run_hashes_are_of_words_in_order(monkeypatch):
    """Hashes agree where runs do, on whichever page and at whatever place of it, however many pages are hashed at once."""
    streams = ["a b c a b c b a c a b c", "", "a b", "é ab c a b c", "a bc", "c a b c"]
    runs = [tuple(w[k : k + 3]) for w in (s.split() for s in streams) for k in range(len(w) - 2)]
    whole, n = pages.run_hashes(streams, 3)
    assert n.tolist() == [10, 0, 0, 4, 0, 2] and len(set(whole.tolist())) == len(set(runs))
    assert all((whole[i] == whole[j]) == (runs[i] == runs[j]) for i in range(len(runs)) for j in range(len(runs)))
    for most in (1, 5, 8, 30):
        monkeypatch.setattr(pages, "AT_ONCE", most)
        some, m = pages.run_hashes(streams, 3)
        assert some.tolist() == whole.tolist() and m.tolist() == n.tolist(), most
    assert not len(pages.run_hashes([], 3)[0])


def test_run_hashes_of_a_very_long_page():
    words = prose(7, 200_000).split() + ["x" * 100_000, *prose(8, 10).split(), "x" * 99_999 + "y"]
    whole, n = pages.run_hashes([" ".join(words), " ".join(words[-9:])], 6)
    assert n.tolist() == [len(words) - 5, 4] and (whole[-4:] == whole[-8:-4]).all()
    assert len(set(whole.tolist())) == len({tuple(words[k : k + 6]) for k in range(len(words) - 5)})
