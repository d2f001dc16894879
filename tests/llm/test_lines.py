import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from tablescribe.llm import lines


def slow(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    tri = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
    c, covered = Counter(tri), set()
    for j, x in enumerate(tri):
        if c[x] > 1:
            covered |= {j, j + 1, j + 2}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab c\n\t\x1c é#|<", max_size=120))
def test_measures_equal_brute_force(text):
    assert lines.clean(text)[:6] == slow(text)


def test_table(docs, nothing, texts):
    got = lines.evaluate(docs).collect()
    want = sorted(((i is None, i or 0), *slow(t)) for i, t in texts)
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0), *[r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")]) for r in got) == want
    assert lines.evaluate(nothing).count() == 0 and lines.cleaned(docs).columns == docs.columns


def test_failing_lines_go_and_prose_stays(words):
    prose = [" ".join(words[i : i + 12]).capitalize() + "." for i in range(0, 240, 12)]
    text = "\n".join([*prose[:10], "Home | About | News | Contact | Login", "All rights reserved.", "*** --- *** --- ***", "", *prose[10:], prose[0]])
    r = lines.clean(text)
    assert r.kept and r.n_failed_lines == 4 and r.cleaned == "\n".join([*prose[:10], "", *prose[10:]])


def test_documents_of_menus_or_symbols_are_rejected(words):
    assert not lines.clean("\n".join(" | ".join(words[i : i + 8]) for i in range(0, 400, 8))).kept
    assert not lines.clean(" ".join(w + "###" for w in words[:300])).kept
    assert lines.clean(" ".join(words[:300])).kept


def test_reasons():
    for line, why in {"Sign in": "navigation", "Copyright 2021 Someone": "boilerplate", "%%% ### !!!": "punctuation", "A plain line of text.": None, "   ": None}.items():
        assert lines.reason(line, set()) == why
    assert lines.reason("Again.", {"Again."}) == "repeated"
