import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tablescribe.llm import alignment

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
A = Tokenizer.from_file(A_PATH)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_OF = {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(PRINTABLE)))}


def spans(pieces):
    at, out = 0, []
    for i, b in pieces:
        out.append((i, at, at + len(b)))
        at += len(b)
    return out


def tokens_of(text):
    """Both sides' (id, start, end) of the whole text, encoded in one go; none if a side doesn't give it back."""
    if not text:
        return [], []
    a = [(i, bytes(BYTE_OF[c] for c in A.id_to_token(i))) for i in A.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode()) for i in B.encode(text)]
    whole = (" " + text).encode()
    return (spans(a), spans(b)) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else ([], [])


def aligned(texts):
    """Brute force: every pair of tokens is compared."""
    both = [tokens_of(t) for t in texts]
    links = [[(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]] for a, b in both]
    count = Counter(p for doc in links for p in doc)
    most = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    out = []
    for (a, b), doc in zip(both, links):
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        groups = [",".join(str(i) for i, s, e in a if lo <= s and e <= hi) + "|" + ",".join(str(i) for i, s, e in b if lo <= s and e <= hi) for lo, hi in zip([0, *cuts], cuts)]
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        out.append((len(a), len(b), len(cuts), len(doc), sum(count[p] == most[p[1]] for p in doc), sum(count[p] for p in doc), digest))
    return out


def result(df):
    return sorted(tuple(r) for r in df.select("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(list("abAB.,'!9  \n\t\x0b\x1c\x85\xa0 éſ世😀▁<|>") + ["it's", " word", "<|endoftext|>", "<0x41>", "  ", "</s>", "\n ", "\x00"]), max_size=30).map("".join))
def test_stretches_give_the_ids_of_the_whole_text(text):
    known = alignment.stretches(A_PATH, B_PATH)
    found = known.of(text) if text else []
    a, b = tokens_of(text)
    assert list(memoryview(b"".join(x[0] for x in found)).cast("H")) == [i for i, *_ in a]
    assert list(memoryview(b"".join(x[1] for x in found)).cast("H")) == [i for i, *_ in b]


@pytest.fixture(scope="module")
def more(texts):
    odd = ["a▁b c", " two  spaces ", "<|endoftext|> and <s> here", "日本語のテキスト", "x" * 400, "it's they're\n\n  indented", "…—“quotes”", "naïve café"]
    return [(i, t and t[:700]) for i, t in texts] + [(100 + i, t) for i, t in enumerate(odd)]


def test_alignment_against_brute_force(spark, more, nothing):
    docs = spark.createDataFrame([(i, t, "c", 1) for i, t in more], "doc_id long, text string, codes string, n long")
    want = sorted(aligned([t for _, t in more]))
    assert result(alignment.align(docs, A_PATH, B_PATH)) == want
    assert result(alignment.align(docs, A_PATH, B_PATH, most_held=10)) == want  # the counts are joined
    assert alignment.align(nothing, A_PATH, B_PATH).count() == 0
    got = {r["doc_id"]: r["n_a"] for r in alignment.align(docs, A_PATH, B_PATH).where("doc_id > 47").collect()}
    assert got[100] == 0 and got[101] > 0


def test_long_texts_go_through_in_blocks(spark, texts, monkeypatch):
    long = " ".join(t for _, t in texts if t)
    docs = spark.createDataFrame([(1, long), (2, "short one"), (None, long[:900] + "\n\n" + long[900:2000])], "doc_id long, text string")
    once = alignment.align(docs, A_PATH, B_PATH).collect()
    monkeypatch.setattr(alignment, "_BLOCK", 300)
    machine = alignment.Sweep(known := alignment.stretches(A_PATH, B_PATH))
    found = known.of(long)
    rows = []
    for k in range(0, len(found), 7):
        a, b = (b"".join(x) for x in zip(*found[k : k + 7]))
        rows += machine.blocks([(1, 1, a, b)], a, b)
    rows.append(machine.done())
    whole = next(r for r in once if r["doc_id"] == 1)
    assert len(rows) == 1 and rows[0][:6] == (1, whole["n_a"], whole["n_b"], whole["n_groups"], whole["n_links"], whole["groups_sha256"])
    assert sum(rows[0][7]) == whole["n_links"]
