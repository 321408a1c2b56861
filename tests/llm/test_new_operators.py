"""Conversation repair, SentencePiece table and periodic runs against plain versions of themselves."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from conftest import SF
from sentencepiece import SentencePieceProcessor

import public_tokenizers
from docprep.llm import audit_repair, periodic_runs, piece_table, queries

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# --- conversations -------------------------------------------------------------------------------


def _best_by_trial(rows):
    """(cost, audit, lines) over every sequence of edits with at most two inserts before a row and at the end."""
    best = None
    for edits in itertools.product(*[["D"] if f in (1, 2) else ["K", "Ru", "Ra", "D"] for *_, f in rows]):
        for ins in itertools.product(["", "u", "a", "ua", "au"], repeat=len(rows) + 1):
            cost, audit, lines = 0, "", []
            for k in range(len(rows) + 1):
                for c in ins[k]:
                    cost, audit = cost + 5, audit + "I"
                    lines.append(("user" if c == "u" else "assistant", ""))
                if k == len(rows):
                    break
                role, text, fault = rows[k]
                e = edits[k]
                audit += e[0]
                cost += {"K": 0, "R": 1, "D": 2}[e[0]] + (5 if fault == 3 and e != "D" else 0)
                if e != "D":
                    lines.append((role if e == "K" else {"Ru": "user", "Ra": "assistant"}[e], text))
            if (best is None or (cost, audit) < best[:2]) and re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in lines)):
                best = (cost, audit, lines)
    return best


def _plain_report(rows):
    """Report by a plain programme over whole strings (each state keeps the least (cost, audit, lines))."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults = set(), []
    for _, role, text in rows:
        shown = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append(1 if not shown else 2 if (role, text) in seen else 3 if shown[-1] not in ".!?" else 0)
        seen.add((role, text))

    def put(cells, state, cell):
        if state not in cells or cell[:2] < cells[state][:2]:
            cells[state] = cell

    def inserted(cells):
        cells = dict(cells)
        for goal, sources in (("u", "-sa"), ("a", "u")):
            for s in sources:
                if s in cells:
                    c, a, x = cells[s]
                    put(cells, goal, (c + 5, a + "I", [*x, ("user:" if goal == "u" else "assistant:")]))
        return cells

    cells = {"-": (0, "", [])}
    for (_, role, text), fault in zip(rows, faults):
        after = {}
        for s, (c, a, x) in inserted(cells).items():
            put(after, s, (c + 2, a + "D", x))
            if fault in (1, 2):
                continue
            c += 5 * (fault == 3)
            for want in {"-": "su", "s": "u", "u": "a", "a": "u"}[s]:
                if role[:1] == want:
                    put(after, want, (c, a + "K", [*x, f"{role}:{text}"]))
                elif want != "s":
                    put(after, want, (c + 1, a + "R", [*x, ("user:" if want == "u" else "assistant:") + text]))
        cells = after
    cells = inserted(cells)
    cost, audit, lines = min(cells[s] for s in "-a" if s in cells)
    turns = {t for t, *_ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    bad = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return gaps, faults.count(1), faults.count(2), faults.count(3), bad, cost, audit, _sha("\n".join(lines))


def test_cheapest_edits_by_trial():
    rng = random.Random(5)
    for _ in range(120):
        rows = [(rng.choice(["system", "user", "assistant", "tool", ""]), "t", rng.choice([0, 0, 0, 1, 3])) for _ in range(rng.randint(0, 3))]
        cost, audit, lines = _best_by_trial(rows)
        assert audit_repair.cheapest([(r[:1], f) for r, _, f in rows]) == (cost, audit)
        assert list(audit_repair.Repaired().lines(audit, [(r, t) for r, t, _ in rows])) == lines


def test_audits_compare_by_common_prefix(monkeypatch):
    rng = random.Random(6)
    root = audit_repair.Node(None, "")

    def audit(text):
        node = root
        for c in text:
            node = audit_repair.Node(node, c)
        return node

    texts = ["".join(rng.choice("DK") for _ in range(rng.randint(0, 12))) for _ in range(60)]
    assert all(audit_repair.less(audit(a), audit(b)) == (a < b) for a in texts for b in texts)
    monkeypatch.setattr(audit_repair, "_MOD", 2)  # nearly every hash collides: equal hashes are verified
    assert all(audit_repair.less(audit(a), audit(b)) == (a < b) for a in texts for b in texts)


def _talks(rng, n):
    rows = []
    for conv in [*range(n), None]:
        for _ in range(rng.choice([0, 1, 2, 3, 9, 14, 30])):
            turn = rng.choice([None, *range(12)])
            rows.append((conv, turn, rng.choice(["system", "user", "user", "assistant", "assistant", "tool", None]), rng.choice(["Hi.", "So", "x\n", " ", "", None, "Why? ", "Ok!"]), "x"))
    return rows


@pytest.mark.parametrize("max_rows", [1000, 4])
def test_repair_plain(spark, max_rows):
    rows = _talks(random.Random(max_rows), 25)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, audit string").repartition(3)
    got = {r.conv_id: tuple(r)[1:] for r in audit_repair.repaired(table, every=table, max_rows=max_rows, block_rows=5).collect()}
    want = {}
    for conv in {r[0] for r in rows}:
        own = [(t, " " if role is None else role, " " if text is None else text) for c, t, role, text, _ in rows if c == conv]
        want[conv] = _plain_report(own)
    assert got == want
    assert audit_repair.repaired(table.where("false")).collect() == []
    assert audit_repair.repaired(table.where("false"), every=table.limit(1)).first()[1:] == (0, 0, 0, 0, 0, 0, "", _sha(""))


def test_repair_query_on_damage(spark):
    talks = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    want = {r.conv_id: [] for r in talks}
    for r in talks:
        role, text = (" " if x is None else x for x in (r.role, r.text))
        kind = zlib.crc32(f"{' ' if r.conv_id is None else r.conv_id}:{' ' if r.turn is None else r.turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        want[r.conv_id] += [(r.turn, "user" if kind == 4 else role, text)] * (1 + (kind == 3))
    got = {r.conv_id: tuple(r)[1:] for r in queries.op11_audit_repair(spark, SF).collect()}
    assert got == {k: _plain_report(v) for k, v in want.items()}


# --- SentencePiece -------------------------------------------------------------------------------

PARTS = [" ", " ", "  ", "▁", "a", "th", "ing", "é", "ü", "\n", "\t", "\0", "\U0001f600", "中", "0", "ﬁ", "<s>", "</s>", "<0x0A>", "...", "\r\n", "Ж", "é", "​"]


def _texts():
    rng = random.Random(7)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    texts += [" " * rng.randint(0, 70) + rng.choice(["", "a", "中", "\n"]) + " " * rng.randint(0, 70) for _ in range(60)]
    return [*texts, "", None, "ab" * 30_000, " ".join(str(i * 7919 % 4001) for i in range(20_000))]


def test_prefix_table_ids_and_text(spark):
    lib = SentencePieceProcessor(model_file=MODEL)
    rows = [(i % 300, t, "x") for i, t in enumerate(_texts())]
    table = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = piece_table.decoded(piece_table.encoded(table, MODEL), MODEL).collect()
    assert len(got) == len(rows)
    both = piece_table.encoded(table, MODEL, keep=["doc_id"], decoded_col="text").collect()
    assert sorted((r.doc_id, r.ids, r.text) for r in both) == sorted((r.doc_id, r.ids, r.decoded) for r in got)
    for r in got:
        ids = lib.encode(r.text or "", add_eos=True)
        assert r.ids == ids and r.decoded == lib.decode(ids)
    assert piece_table.encoded(table.where("false"), MODEL).collect() == []


def test_forgotten_stretches_and_pairs_come_back(monkeypatch):
    monkeypatch.setattr(piece_table, "CACHE_BYTES", 2_000)
    monkeypatch.setattr(piece_table, "FITTING", 50)
    table = piece_table.PieceTable(MODEL)
    for t in _texts()[:200]:
        assert table.encode(t) == b"".join(i.to_bytes(4, "little") for i in table.lib.encode(t or ""))


def test_sentencepiece_query(spark):
    lib = SentencePieceProcessor(model_file=MODEL)
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = lib.encode(r.text or "", add_eos=True)
        want[r.doc_id] = (len(ids), _sha(" ".join(map(str, ids))), _sha(lib.decode(ids)))
    assert {r.doc_id: tuple(r)[1:] for r in queries.op12_piece_table(spark, SF).collect()} == want


# --- periodic runs -------------------------------------------------------------------------------


def _plain_runs(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(6, 4 * q) and not any(w[i : i + n - p] == w[i + p : i + n] for p in range(1, q)):
                out.append((i, n, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def _plain_collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def _periodic_texts():
    rng = random.Random(8)
    texts = [None, "", " \n", "a " * 6, "a " * 5, "x y " * 300, " ".join(str(i % 37) for i in range(1200)), " ".join(map(str, range(400)))]
    a, b = ["0"], ["0", "1"]
    while len(b) < 600:
        a, b = b, b + a
    texts.append(" ".join(b))
    for _ in range(60):
        w = [str(rng.randrange(rng.choice([1, 2, 2, 3, 30]))) for _ in range(rng.randint(1, 120))]
        s, p = rng.randrange(len(w)), rng.randint(1, 14)
        for i in range(s, len(w)):
            w[i] = w[s + (i - s) % min(p, len(w) - s)]
        if rng.random() < 0.5:
            w[rng.randrange(len(w))] = "0"
        texts.append(rng.choice([" ", "\t", " \n"]).join(w))
    return texts


@pytest.mark.parametrize("tile_words", [16_384, 4])
def test_periodic_runs_plain(spark, tile_words):
    rows = [(None if i % 11 == 5 else i // 2, t, "x") for i, t in enumerate(_periodic_texts())]
    rows += rows[:12]  # repeated rows
    table = spark.createDataFrame(rows, "doc_id long, text string, runs string").repartition(3)
    got = periodic_runs.periodic_runs(table, tile_words=tile_words).collect()
    want = []
    for d, t, _ in rows:
        w = _words(t)
        runs = _plain_runs(w)
        want.append((d is None, d or 0, len(w), tuple(runs), _plain_collapsed(w, runs)))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, tuple((x.start, x.length, x.period) for x in r.runs), r.collapsed_text) for r in got) == sorted(want)
    assert periodic_runs.periodic_runs(table.where("false")).collect() == []


def test_tiles_of_long_documents_stitch():
    import numpy as np

    rng = np.random.default_rng(9)
    w = rng.integers(0, 50, 3000)
    w[500:1700] = np.tile(w[500:650], 8)
    w[2000:2100] = np.tile(w[2000:2005], 20)
    found = {}
    for octave, start, part in periodic_runs.tiles(w.astype(np.int32), 64):
        for (_, q), own in periodic_runs.tile_fragments(part.astype(np.int64), octave, start, 64).found.items():
            found.setdefault(q, []).extend(own)
    runs = []
    for q, own in found.items():
        lo, hi = None, None
        for a, b in sorted(own):
            if hi is not None and a <= hi:
                hi = max(hi, b)
                continue
            runs += [(lo, hi - lo + q, q)] if hi is not None else []
            lo, hi = a, b
        runs.append((lo, hi - lo + q, q))
    runs = sorted(r for r in runs if r[1] >= max(6, 4 * r[2]))
    assert runs == _plain_runs(w.tolist()) and {150, 5} <= {q for *_, q in runs}


def test_periodic_query_on_damage(spark):
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        w, h = _words(r.text), zlib.crc32(str(r.doc_id).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = _plain_runs(w) if n < 600 else None
        if runs is None:
            continue
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=None)
        top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        want[r.doc_id] = (len(runs), *top, _sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), _sha(_plain_collapsed(w, runs)))
    got = {r.doc_id: tuple(r)[1:] for r in queries.op13_periodic_runs(spark, SF).collect()}
    assert len(want) > 150 and sum(v[0] > 0 for v in want.values()) > 10
    assert {k: got[k] for k in want} == want
