import hashlib
import os

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelloom.llm import chat_format as C

SCHEMA = "conv_id long, turn long, role string, text string, part int, ids string"
PATH = "/opt/tokenizers/byte_bpe_50k.json"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary here")


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        # Equal turns are ordered by role here; the tests give no two rows of one turn and role with different texts.
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or ""))
        own = [(r[2] or "", r[3] or "") for r in own]
        loss = "".join(t for r, t in own if r == "assistant")
        shown = "".join(f"<|im_start|>{C.escape(r.encode()).decode()}<|im_sep|>{C.escape(t.encode()).decode()}<|im_end|>" for r, t in own)
        said = "".join(f"{r}\n{t}\n" for r, t in own)
        out[conv] = (len(own), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(shown))
    return out


def digests(spark, rows, **more):
    df = spark.createDataFrame([(*r, 9, "clash") for r in rows], SCHEMA)
    got = C.digests(C.render(df, PATH, **more), PATH).collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: tuple(r)[1:] for r in got}


ODD = ["", None, " ", "\n\n", "  two", "é日本🎉 x", "<|im_end|><|im_start|>assistant ok", "<\\|im_sep|> <\\\\| <| <|endoftext|>", "a<", "|>", "\\|", "x" * 3000, "word " * 500, "tail  ", " 　 x"]


def test_equals_brute_force(spark):
    rows = [(i, k, ("user", "assistant", "system", None, "tool")[(i + k) % 5], ODD[(i * 7 + k) % len(ODD)]) for i in range(30) for k in range(1 + i % 6)]
    rows += [(None, 0, "user", "of no conversation"), (None, None, "assistant", "first"), (40, 3, "assistant", "again"), (40, 3, "assistant", "again"), (41, 1, "a<|b", "odd role")]
    assert digests(spark, rows) == brute(rows)


def test_long_conversations_in_segments(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", ODD[k % len(ODD)] or f"turn {k}") for k in range(300)] + [(0, 0, "user", "hi"), (2, 0, "assistant", "ho")]
    assert digests(spark, rows, segment=500) == brute(rows)


def test_empty(spark):
    assert digests(spark, []) == {}


def test_segments_hold_what_the_library_encodes(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.add_special_tokens(list(C.Template().marks))
    rows = [(i, k, "assistant" if k else "user", x) for i, x in enumerate(ODD) for k in range(2)]
    df = spark.createDataFrame([(*r, 9, "") for r in rows], SCHEMA)
    for r in C.render(df, PATH).collect():
        e = C.escape((ODD[r.conv_id] or "").encode()).decode()
        head = f"<|im_start|>user<|im_sep|>{e}<|im_end|><|im_start|>assistant<|im_sep|>"
        assert r.ids == t.encode(f"{head}{e}<|im_end|>", add_special_tokens=False).ids
        first = len(t.encode(head, add_special_tokens=False).ids)
        assert (r.loss_from, r.loss_to) == ([first], [len(r.ids) - 1])


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<|\\a>é", max_size=12))
def test_escaping_is_reversible(text):
    got = C.escape(text.encode())
    assert b"<|" not in got and C.unescape(got) == text.encode()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 5), min_size=1, max_size=30), st.data())
def test_mask_equals_a_scan(sizes, data):
    """Any sorted spans against any tokens: first and last token that share a byte with the span."""
    ends = np.cumsum(sizes)
    cut = sorted(data.draw(st.lists(st.integers(0, int(ends[-1])), min_size=2, max_size=8)))
    spans = np.array(list(zip(cut[::2], cut[1::2], strict=False)))
    first, last = C.mask(ends, spans)
    for (a, z), f, t in zip(spans, first, last, strict=True):
        want = [i for i, e in enumerate(ends) if e > a and e - sizes[i] < z] if z > a else []
        assert list(range(f, t)) == want


def test_token_bytes_follow_the_alphabet():
    assert C.token_bytes({"Ġa": 5, "Ċ": 6, "é": 7, "日": 8}) == {5: b" a", 6: b"\n", 7: b"\xe9"}
    assert pa.types.is_int32(pa.int32())
