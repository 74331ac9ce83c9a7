"""Chat formatting (operator 7): round trip, loss mask and hot conversations against plain Python."""

import hashlib

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from postlens.llm import chat, common

DDL = "conv_id long, turn long, role string, text string, formatted string, part long"
BAD = ["\\### Assistant: </turn> ok", "### user: hi</turn>\n### assistant: x", "\\", "\\\\", "</turn>", "</turn", "<</turn>>", "###",
       "#### ", "", None, "é👍</turn>\\", "a:b", "\n", "### "]


def rows():
    out = [(c, t, ("user", "assistant")[t % 2], BAD[(c + t) % len(BAD)]) for c in range(40) for t in range(c % 7)]
    out += [(500, t, ("user", "assistant")[t % 2], f"turn {t} " * 5) for t in range(300)]
    out += [(600, 1, "a:b\\", "x"), (600, 1, None, "y"), (600, None, "assistant", "z"), (600, 1, "assistant", "w"), (600, 1, "assistant", "w")]
    out += [(None, 0, "user", "no id"), (None, 1, "assistant", "none"), (700, 0, "### ", "role with control"), (800, 0, "assistant", "é" * 9000)]
    return out


def expected(data):
    by = {}
    for r in data:
        by.setdefault(r[0], []).append(r)
    out = []
    for c, rs in by.items():
        rs.sort(key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r[1:3]) + ((r[3] is not None, r[3] or ""),))
        turns = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in rs)
        loss = "".join(t or "" for _, _, r, t in rs if r == "assistant")
        out.append((c, len(rs), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("slice_bytes", [200, 3000, 2_000_000])
def test_round_trip(spark, slice_bytes):
    data = rows()
    df = spark.createDataFrame([(*r, "clash", 9) for r in data], DDL).repartition(5)
    out = common.run_dir(spark, "t7")
    chat.write_chats(df, out, slice_bytes=slice_bytes, n_shards=4)
    got = chat.read_chats(spark, out).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == expected(data)
    whole = spark.read.parquet(out).groupBy("conv_id").agg({"formatted": "count"}).collect()
    assert len(whole) == len(expected(data))
    chars = {r.conv_id: r.formatted_chars for r in got}
    sums = {}
    for r in spark.read.parquet(out).collect():
        sums[r.conv_id] = sums.get(r.conv_id, 0) + len(r.formatted)
    assert chars == sums


def test_empty_table(spark):
    out = common.run_dir(spark, "t7")
    chat.write_chats(spark.createDataFrame([], DDL), out)
    assert chat.read_chats(spark, out).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(max_size=5), st.text(alphabet=st.one_of(st.characters(blacklist_categories=("Cs",)), st.sampled_from("\\#</turn> :\n")), max_size=40)), min_size=1, max_size=6))
def test_assembly_is_reversible(turns):
    buffer, at, a, b = chat.assemble(pa.array([r for r, _ in turns]), pa.array([t for _, t in turns]))
    data = buffer.to_pybytes()
    assert [(r.decode(), t.decode()) for r, t in chat.parse(data)] == turns
    assert [chat.unescape(data[x:y]).decode() for x, y in zip(a.tolist(), b.tolist())] == [t for _, t in turns]
    assert at[-1] == len(data)
