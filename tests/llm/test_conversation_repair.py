"""Cheapest edits against a search over all edit strings, and whole queries against plain Python."""

import hashlib
import heapq
import random
import re
import zlib

from scoreloom.llm import conversation_repair as repair
from scoreloom.llm.queries import QUERIES

SPACES = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string, cost int, place string"


def by_search(codes):
    """Edit strings in the order of (cost, text) until one gives a complete conversation."""
    heap = [(0, "", "", 0)]
    while True:
        cost, edits, roles, i = heapq.heappop(heap)
        if i == len(codes) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, edits
        steps = [("I", 2, c, 0) for c in "ua"]
        if i < len(codes):
            role, fault = codes[i]
            steps.append(("D", 3, "", 1))
            if fault not in "bd":
                steps += [("K", fault == "t", role, 1), *(("R", 2 + (fault == "t"), c, 1) for c in "ua")]
        for edit, more, role, n in steps:
            if re.fullmatch("s?(ua)*u?", roles + role) and len(roles + role) <= 2 * len(codes) + 3:
                heapq.heappush(heap, (cost + more, edits + edit, roles + role, i + n))


def some_codes(rng, n):
    return [rng.choice("suua?") + rng.choice("bdt----") for _ in range(n)]


def test_search_finds_the_cheapest():
    rng = random.Random(3)
    for n in range(6):
        for _ in range(60):
            codes = some_codes(rng, n)
            assert repair.whole_repair("".join(codes)) == by_search(codes), codes


def test_blocks_join_to_the_whole():
    rng = random.Random(4)
    for _ in range(60):
        codes = some_codes(rng, 14)
        cuts = sorted(rng.sample(range(1, 14), 3))
        tables = [repair.block_table("".join(codes[i:j])) for i, j in zip([0, *cuts], [*cuts, 14])]
        ends = [(c, e) for i, o, c, e in repair.joined_tables(tables) if i == repair.START and o in repair.COMPLETE]
        assert min(ends) == repair.whole_repair("".join(codes))


def plain(rows):
    read = lambda v: " " if v is None else str(v)
    conversations = {}
    for c, turn, role, text in rows:
        out = conversations.setdefault(c, [])
        lot = zlib.crc32(f"{read(c)}:{read(turn)}".encode()) % 20
        role, text = read(role), read(text)
        text = "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text
        if lot:
            out += [(turn, "user" if lot == 4 else role, text)] * (2 if lot == 3 else 1)
    for c, kept in conversations.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))
        codes, seen = [], set()
        for _, role, text in kept:
            bare = text.strip(SPACES)
            codes.append((role[:1], "b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "-"))
            seen.add((role, text))
        turns = [t for t, _, _ in kept if t is not None]
        cost, audit = repair.whole_repair("".join((r if r in ("s", "u", "a") else "?") + f for r, f in codes)) if codes else (0, "")
        state, out, rest = "", [], iter(kept)
        for edit in audit:
            due = "assistant" if state == "u" else "user"
            if edit == "I":
                out.append((due, ""))
            else:
                _, role, text = next(rest)
                if edit != "D":
                    out.append((role if edit == "K" else due, text))
            state = out[-1][0][0] if out else ""
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in out))
        yield (
            c, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(sum(f == x for _, f in codes) for x in "bdt"),
            sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in zip(codes, codes[1:])), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest(),
        )


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, "p") for r in rows], SCHEMA)


def awkward_rows():
    rng = random.Random(5)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None]
    texts = ["One. Two!", "no stop", "", "  \n", None, "Done.", "Again?", "long " * 3000 + "end."]
    rows = [(c, t, rng.choice(roles), rng.choice(texts)) for c in [*range(40), None] for t in range(rng.randrange(1, 7))]
    rows += [(7, None, "user", "Before all."), (7, None, "user", "Before all."), (None, None, None, None), (3, 2, "user", "Same turn."), (3, 2, "user", "Same turn.")]
    rows += [(99, t, ("user", "assistant")[t % 2], f"Turn {t // 3}.") for t in range(400)]
    return rows


def key(row):
    return row[0] is None, row[0] or 0


def test_reports_equal_plain_python(spark):
    rows = awkward_rows()
    got = repair.repair_report(conversations(spark, rows)).collect()
    assert sorted(map(tuple, got), key=key) == sorted(plain(rows), key=key)


def test_query_reads_its_table(spark, tmp_path):
    rows = [r for r in awkward_rows() if r[0] != 99]
    conversations(spark, rows).write.parquet(str(tmp_path / "conversations.parquet"))
    got = QUERIES["op13_conversation_repair"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=key) == sorted(plain(rows), key=key)


def test_repaired_rows_are_complete(spark):
    rows = [(c, t, ("user", "assistant")[(c + t) % 2], f"Text {t}.") for c in range(5) for t in range(6)]
    ordered, report = repair.repair(conversations(spark, rows).select("conv_id", "turn", "role", "text"))
    turns = repair.repaired_rows(ordered, report).orderBy("conv_id", "turn").collect()
    for c in range(5):
        roles = [t.role for t in turns if t.conv_id == c]
        assert roles == ["user", "assistant"] * (len(roles) // 2) and roles
        assert [t.turn for t in turns if t.conv_id == c] == list(range(len(roles)))


def test_empty_table(spark):
    assert repair.repair_report(conversations(spark, [])).collect() == []
