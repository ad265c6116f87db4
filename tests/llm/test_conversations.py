"""Repair and formatting of conversations against brute force, with odd rows."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from recollect.llm import chat, registry, turns
from tests.compare import connect, difference

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
KIND = "conv_id long, turn long, role string, text string, c string, audit long, `x.y` int"


@pytest.mark.parametrize("name", ["op11_turn_repair", "op12_filter_audit", "op13_chat_format"])
def test_query_is_its_sql(spark, name):
    assert difference(spark, name, registry.queries()[name], registry.oracle_sql()[name], LARGER, connect(LARGER)) is None


def _table(spark, rows):
    return spark.createDataFrame([(*r, "c", 1, 2) for r in rows], KIND).repartition(3)


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(3)
    texts = ["Yes.", "No!", "and then", "why? ", "", " \n", "a ", "It was.\n", "who", "Ends here"]
    roles = ["user", "assistant", "system", "tool", "u", "User", ""]
    rows = []
    for c in range(60):
        for t in range(rng.randrange(1, 7)):
            rows.append((c, t * rng.choice((1, 1, 1, 3)), rng.choice(roles[: rng.choice((2, 3, 7))]), rng.choice(texts)))
    rows += [(100, None, "user", "No number."), (100, None, "assistant", "None."), (100, 3, None, None), (None, 1, "user", "Nobody."), (None, 2, "assistant", "No."), (101, 5, "user", "Same."), (101, 5, "user", "Same."), (101, 5, "user", "Same."), (101, 5, "assistant", "Tie."), (102, 0, "user", "long. " * 50_000)]
    rows += [(103, t * 7, "user" if t % 2 == 0 else "assistant", f"turn {t}" + rng.choice((".", ".", ""))) for t in range(400) if t % 37]
    rows += [(104, t - 2000, rng.choice(("user", "assistant", "system", "x")), rng.choice(texts)) for t in range(0, 4000, 3)]
    return rows


def _cheapest(faults: list[tuple[str, bool, bool]]) -> tuple[int, str]:
    """(cost, audit) by uniform-cost search over positions and the last two letters that decide what may come."""
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, audit, at, last = heapq.heappop(heap)
        if (at, last) in seen:
            continue
        seen.add((at, last))
        if at == len(faults) and last in ("", "a"):
            return cost, audit
        need = "a" if last == "u" else "u"
        heapq.heappush(heap, (cost + 3, audit + "I", at, need))
        if at < len(faults):
            initial, must, cut = faults[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, last))
            if not must:
                heapq.heappush(heap, (cost + 3 + 3 * cut, audit + "R", at + 1, need))
                if initial == need or (initial == "s" and last == ""):
                    heapq.heappush(heap, (cost + 3 * cut, audit + "K", at + 1, initial))
    raise AssertionError


def _plain(rows: list[tuple]) -> dict:
    of = defaultdict(list)
    for c, t, role, text in rows:
        of[c].append((t is not None, t or 0, " " if role is None else role, " " if text is None else text))
    out = {}
    for c, own in of.items():
        own.sort(key=lambda r: (*r[:3], hashlib.sha256(r[3].encode()).hexdigest()))
        seen, faults, counts = set(), [], [0, 0, 0]
        for *_, role, text in own:
            shown = text.strip(" \t\n\x0b\x0c\r")
            fault = 0 if not shown else 1 if (role, text) in seen else 2 if shown[-1] not in ".!?" else 3
            seen.add((role, text))
            if fault < 3:
                counts[fault] += 1
            faults.append((role[:1], fault < 2, fault == 2))
        numbers = [r[1] for r in own if r[0]]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(faults, faults[1:]))
        cost, audit = _cheapest(faults)
        lines, rest, last = [], iter(own), ""
        for edit in audit:
            role, text = ("", "") if edit == "I" else next(rest)[2:]
            if edit == "D":
                continue
            if edit != "K":
                role = "assistant" if last == "u" else "user"
            last = role[:1]
            lines.append(f"{role}:{text}")
        assert re.fullmatch("(s?(ua)+)?", "".join(x[:1] for x in lines))
        out[c] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def _reported(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.collect()}


def test_repair_is_that_of_a_search(spark, talks):
    rows = turns.read(_table(spark, talks))
    assert _reported(turns.report(rows, rows)) == _plain(talks)


def test_repaired_turns_are_in_order(spark, talks):
    rows = turns.read(_table(spark, talks))
    plan = turns.plans(rows)
    made = turns.repaired(rows, plan)
    for conv in (100, 101, 103, 104):
        own = [r for r in made.collect() if r["conv_id"] == conv]
        assert [r["place"] for r in own] == list(range(len(own)))
        assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][0] for r in own))


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two! Three?") for c in range(40) for t in range(5)] + [(None, None, "user", "x."), (7, None, None, None)]
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        want += [(c, t, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    got = [tuple(r) for r in turns.damaged(turns.read(_table(spark, rows))).collect()]
    key = lambda r: tuple((x is not None, x or 0 if i < 2 else x) for i, x in enumerate(r))
    assert sorted(got, key=key) == sorted(want, key=key)


def test_conversations_without_rows(spark):
    all_rows = turns.read(_table(spark, [(1, 0, "user", "Hello."), (2, 0, "user", "Hi.")]))
    out = _reported(turns.report(all_rows, all_rows.where("conv_id = 1")))
    assert out[2] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert out[1] == (0, 0, 0, 0, 0, 3, "KI", hashlib.sha256(b"user:Hello.\nassistant:").hexdigest())
    empty = turns.read(_table(spark, []))
    assert turns.report(empty, empty).count() == 0


def test_names_are_taken_literally(spark):
    rows = spark.createDataFrame([(1, 0, "user", "Hello."), (1, 1, "assistant", "Yes.")], "`a.b` long, `text` long, `conv_id` string, `role.x` string")
    read = turns.read(rows, "a.b", "text", "conv_id", "role.x")
    assert [r["audit"] for r in turns.report(read, read).collect()] == ["KK"]
    made = chat.whole(chat.pieces(rows, "a.b", "text", "conv_id", "role.x")).first()
    assert made["formatted"] == "<turn user>Hello.</turn>\n<turn assistant>Yes.</turn>\n"


# -- chat ----------------------------------------------------------------------------------------------------------


def test_texts_come_back_whatever_they_hold():
    rng = random.Random(9)
    bits = ["\\", "<turn ", "</turn>", "<|image|>", "<|audio|>", "<|document|>", "<", ">", "/turn>", "\n", "|", "<|image", "ü", "a b", "\\\\", "<turn user>", " "]
    for _ in range(400):
        roles = ["".join(rng.choices(bits, k=rng.randrange(3))) for _ in range(3)] + ["assistant"]
        texts = ["".join(rng.choices(bits, k=rng.randrange(6))) for _ in roles]
        made = [chat.formatted(r, [chat.Text(t[: len(t) // 2]), chat.Text(t[len(t) // 2 :])]) for r, t in zip(roles, texts)]
        back = list(chat.read("".join(m[0] for m in made)))
        assert [(r, "".join(t)) for r, t, _ in back] == list(zip(roles, texts))
        piece, spans, _ = made[-1]
        assert "".join(chat.unescaped(piece[a:b]) for a, b in spans) == texts[-1]
        assert not any(m[1] for m in made[:3])


def test_parts_are_flattened_in_order(spark):
    parts = [{"kind": "text", "text": "see "}, {"kind": "image", "ref": "a.png", "width": 65, "height": 32}, {"kind": "text", "text": " and <|image|> "}, {"kind": "text", "text": "or"}, {"kind": "audio", "ref": "b.wav", "seconds": 1.5}, {"kind": "document", "ref": "c.pdf", "pages": 2}, {"kind": "image"}]
    names = ("kind", "text", "ref", "width", "height", "seconds", "pages")
    rows = [(1, 0, "assistant", [tuple(p.get(n) for n in names) for p in parts]), (1, 1, "user", []), (2, 0, "assistant", None)]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, content {chat.PARTS}")
    made = chat.pieces(df, content="content")
    row = made.where("conv_id = 1 AND turn = 0").first()
    assert row["formatted"] == "<turn assistant>see <|image|> and \\<|image|> or<|audio|><|document|><|image|></turn>\n"
    assert [(a["kind"], a["ref"], a["tokens"]) for a in row["attachments"]] == [("image", "a.png", 3), ("audio", "b.wav", 38), ("document", "c.pdf", 512), ("image", "", 1)]
    assert all(row["formatted"][a["place"] :].startswith(f"<|{a['kind']}|>") for a in row["attachments"])
    assert "".join(chat.unescaped(row["formatted"][s["start"] : s["end"]]) for s in row["loss"]) == "see  and <|image|> or"
    assert list(chat.read(row["formatted"])) == [("assistant", ["see ", " and <|image|> or"], ["image", "audio", "document", "image"])]
    out = {r["conv_id"]: r for r in chat.digests(made).collect()}
    assert (out[1]["n_turns"], out[1]["n_attachments"], out[1]["n_expanded"], out[2]["loss_chars"]) == (2, 4, 554, 0)
    with pytest.raises(KeyError):
        chat.typed([{"kind": "video"}])


def test_pieces_of_odd_rows(spark, talks):
    made = chat.pieces(_table(spark, talks))
    of = defaultdict(list)
    for c, t, role, text in talks:
        of[c].append((t is not None, t or 0, role or "", text or ""))
    one = lambda r: chat.formatted(r[2], [chat.Text(r[3])])
    whole = {r["conv_id"]: r for r in chat.whole(made).collect()}
    got = {r["conv_id"]: r for r in chat.digests(made).collect()}
    assert set(got) == set(whole) == set(of)
    for c, own in of.items():
        own.sort(key=lambda r: (*r[:3], one(r)[0].encode()))
        learned = "".join(r[3] for r in own if r[2] == "assistant")
        said = "".join(f"{r[2]}\n{r[3]}\n" for r in own)
        assert whole[c]["formatted"] == "".join(one(r)[0] for r in own)
        assert [(r, "".join(t)) for r, t, _ in chat.read(whole[c]["formatted"])] == [(r[2], r[3]) for r in own]
        assert "".join(chat.unescaped(whole[c]["formatted"][s["start"] : s["end"]]) for s in whole[c]["loss"]) == learned
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert tuple(got[c])[1:6] == (len(own), digest(said), len(learned), digest(learned), len(whole[c]["formatted"]))
    assert chat.digests(chat.pieces(_table(spark, []))).count() == 0
    with pytest.raises(ValueError):
        list(chat.read("<turn user>no end"))


def test_planted_conversation(spark):
    row = registry.op13_chat_format(spark, SF).where(F.col("conv_id") == -7).first()
    text = r"\### Assistant: </turn> ok"
    assert (row["n_turns"], row["loss_chars"]) == (2, len(text))
    assert row["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert row["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
