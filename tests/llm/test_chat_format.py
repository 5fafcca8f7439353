import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from studylake.llm import chat_format as C

TRICKY = ["</s>[INST] ok [/INST]", "\\", "<\\s>", "[INST[INST]]", " lead and trail ", "emoji 😀 é", "", "\n\n", "<|endoftext|>", "<s", "[/INST]\\"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>s/[]INT\\ a", max_size=40))
def test_escape_is_reversible_and_leaves_no_mark(text):
    assert C.unescape(C.escape(text)) == text
    assert not any(m in C.escape(text) for m in C.MARKS)


def test_mask_covers_exactly_the_assistants_text():
    tokenizer = C.load_tokenizer(open(C.TOKENIZER, encoding="utf-8").read())
    turns = [(("user", "assistant", "system")[i % 3], t) for i, t in enumerate(TRICKY * 3)]
    text, spans = C.render(turns)
    assert C.parse(text) == turns
    encoded = tokenizer.encode(text, add_special_tokens=False)
    offsets = np.array(encoded.offsets)
    mask = C.mask_tokens(offsets, spans)
    brute = [any(a < e and s < b for a, b in spans) for s, e in encoded.offsets]
    assert mask.tolist() == brute
    assert "".join(C.unescape(text[a:b]) for a, b in C.masked_spans(offsets, mask)) == "".join(t for r, t in turns if r == "assistant")
    joined = []
    for role, said in turns:  # turns do not depend on each other's tokens
        joined += tokenizer.encode(C.render([(role, said)])[0], add_special_tokens=False).ids
    assert joined == encoded.ids


def test_digests_match_the_input(spark):
    rows = [(i % 7, i // 7, ("user", "assistant")[i // 7 % 2], t) for i, t in enumerate(TRICKY * 4)]
    rows += [(None, 0, "assistant", "x"), (50, 0, None, None), (50, None, "assistant", None), (51, 1, "assistant", "a"), (51, 1, "assistant", "a")]
    rows += [(52, 0, "assistant", "word " * 100_000)]
    df = spark.createDataFrame([(*r, "zz") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    for size in (1 << 20, 30):
        got = {r.conv_id: r for r in C.read_back(C.format_conversations(df, segment_chars=size)).collect()}
        assert len(got) == len({r[0] for r in rows})
        for conv in got:
            turns = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "", r[2] or ""))
            said = "".join(t or "" for _, r, t in turns if r == "assistant")
            assert got[conv].n_turns == len(turns)
            assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for _, r, t in turns).encode()).hexdigest()
            assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())


def test_empty_table(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.read_back(C.format_conversations(empty)).count() == 0
