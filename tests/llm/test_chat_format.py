"""Chat formatting against a plain writer, and exact round trips."""

import random
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest

from terraweave.llm import chat_format

SCHEMA = "conv_id long, turn long, role string, text string, part string, loss string"
PIECES = ["\\", "<", ">", "<turn", "</turn>", "\n</turn>\n", "<turn user>\n", "\\l", "\\\\", "turn", "/turn", "é", "ü<", "\U0001f600", "ok ",
          "### Assistant: ", "\n", ""]


def turns(seed=1):
    rng = random.Random(seed)
    text = lambda k: "".join(rng.choice(PIECES) for _ in range(rng.randrange(k)))
    data = []
    for conv in range(60):
        for turn in range(rng.choice([1, 2, 3, 9])):
            role = rng.choice(["user", "assistant", "assistant", "system", text(4)])
            data.append((conv, turn, role, text(12)))
    data += [(7, t, "assistant" if t % 2 else "user", text(8)) for t in range(10, 900)]  # a third and more of all rows
    data += [(None, None, None, None), (None, 1, "assistant", None), (None, 0, None, "x"), (70, None, "user", "a"), (70, 0, "assistant", "b"),
             (71, 0, "user", "z" * 300_000 + "\\" * 9), (71, 1, "assistant", "<turn" * 50_000), (72, 0, "assistant", "same"),
             (72, 0, "assistant", "same"), (72, 0, "assistant", "other"), (73, 0, "user", "<"), (73, 1, "turn", "turn")]
    rng.shuffle(data)
    return data


def plain(data):
    """{conv_id: (turns, formatted text, text under the loss)}."""
    out = defaultdict(list)
    for conv, turn, role, text in data:
        out[conv].append((turn is not None, turn or 0, role or "", text or ""))
    mark = lambda s: s.replace("\\", "\\\\")
    found = {}
    for conv, own in out.items():
        own = sorted(own, key=lambda t: (*t[:2], t[2].encode(), t[3].encode()))
        written = "".join(
            f"<turn {mark(r).replace('<', chr(92) + 'l').replace('>', chr(92) + 'g')}>\n"
            f"{mark(t).replace('<turn', chr(92) + 'lturn').replace('</turn', chr(92) + 'l/turn')}\n</turn>\n" for *_, r, t in own)
        found[conv] = ([t[2:] for t in own], written, "".join(t for *_, r, t in own if r == "assistant"))
    return found


def table(spark, data):
    return spark.createDataFrame([(*r, "p", "l") for r in data], SCHEMA).repartition(3)


@pytest.mark.parametrize("small", [False, True])
def test_round_trip(spark, monkeypatch, small):
    """With small slices, parts and windows, conversations go over several parts."""
    if small:
        monkeypatch.setattr(chat_format, "SLICE_BYTES", 300)
        monkeypatch.setattr(chat_format, "PART_BYTES", 2000)
        monkeypatch.setattr(chat_format, "WINDOW", 64)
    data, want = turns(), plain(turns())
    parts = chat_format.format_turns(table(spark, data))
    rows = sorted(parts.collect(), key=lambda r: r.part)
    written = defaultdict(str)
    for r in rows:
        written[r.conv_id] += r.formatted
    assert written == {c: w[1] for c, w in want.items()}
    if small:
        assert len(rows) > len(want)
    got = defaultdict(list)
    for r in sorted(chat_format.read_turns(parts).collect(), key=lambda r: (r.part, r.nth)):
        got[r.conv_id].append((r.role, r.text))
        assert r.trained == (r.role == "assistant")
    assert got == {c: w[0] for c, w in want.items()}
    digest = lambda s: sha256(s.encode()).hexdigest()
    assert sorted((tuple(r) for r in chat_format.digests(parts).collect()), key=str) == sorted((
        (c, len(own), digest("".join(f"{r}\n{t}\n" for r, t in own)), len(loss), digest(loss), len(text))
        for c, (own, text, loss) in want.items()), key=str)


def test_nothing(spark):
    none = table(spark, turns()[:1]).limit(0)
    assert chat_format.format_turns(none).count() == 0
    assert chat_format.digests(chat_format.format_turns(none)).count() == 0


def test_marks_end_at_a_text():
    """A control string is one only inside a text, not across two."""
    buffer, bounds, starts, sizes = chat_format.assemble(pa.array(["a", None, "<b>"]), pa.array(["<", "turn</tur", None]))
    raw = buffer.to_pybytes()
    assert raw == b"<turn a>\n<\n</turn>\n<turn >\nturn</tur\n</turn>\n<turn \\lb\\g>\n\n</turn>\n"
    assert [raw[a:a + n] for a, n in zip(starts, sizes)] == [b"<", b"turn</tur", b""]
    assert np.diff(bounds).sum() == len(raw)
    with pytest.raises(ValueError):
        list(chat_format.parse(b"no turn"))
