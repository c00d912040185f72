import random
import re

import pytest

from sedimenta.llm import splitting as p1

SPACE = {*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}


def tokens(text):
    return len("".join(" " if ord(c) in SPACE else "x" for c in text).split())


def brute(text):
    """The boundary by looking at every gap."""
    if text is None or tokens(text) <= p1.LIMIT:
        return None
    mark = "".join("\n" if c in "\n\r" else " " if ord(c) in SPACE else c for c in text.replace("\r\n", "\n"))
    words, gaps, at = [], [], 0
    for m in re.finditer(r"[^ \n]+", mark):
        if words:
            gaps.append(mark[at : m.start()])
        words.append(m.group())
        at = m.end()
    kinds = [0 if g.count("\n") > 1 else 1 if "\n" in g else 2 if re.search(r"[.!?…][\"'”’»)\]]*$", w) else 3 for w, g in zip(words, gaps)]
    for kind, name in enumerate(("paragraph", "line", "sentence")):
        longest = run = 1
        for k in kinds:
            run = 1 if k <= kind else run + 1
            longest = max(longest, run)
        if longest <= p1.LIMIT:
            return name
    return "word"


def text_of(rng, n):
    out = []
    gap = rng.choice([0.02, 0.005, 0.0005])
    for _ in range(n):
        out.append("".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 9))))
        x = rng.random()
        if x < gap:
            out.append(rng.choice(["\n\n", "\r\n \t\r\n", "\n \n\n", "\r\r"]))
        elif x < 2 * gap:
            out.append(rng.choice(["\n", "\r\n", " \n\t", "\r"]))
        elif x < 5 * gap:
            out.append(rng.choice([". ", "!) ", '." ', "… ", "? "]))
        else:
            out.append(rng.choice([" ", "  ", " ", " ", "\t"]))
    return rng.choice(["", "\n ", " "]) + "".join(out)


@pytest.mark.parametrize("seed", range(6))
def test_ranges_give_what_the_whole_text_gives(seed):
    rng = random.Random(seed)
    for _ in range(25):
        text = text_of(rng, rng.choice([0, 3, 500, 520, 1500, 3000]))
        whole = p1.longest(text)
        assert whole[0] == tokens(text) and p1.boundary_of(whole) == brute(text)
        ranges = list(p1.slice_ranges(text, 700))
        assert ranges[0][2] == 0 and ranges[-1][3] == len(text) and all(a[3] == b[2] for a, b in zip(ranges, ranges[1:]))
        sizes = p1.stitch([p1.range_table(text[h:s], text[s:e]) for _, h, s, e in ranges])
        assert p1.boundary_of(sizes) == brute(text) and sizes[0] == whole[0]


def test_pieces_cover_and_overlap():
    rng = random.Random(9)
    for _ in range(20):
        text = text_of(rng, 2500)
        cuts = p1.pieces(text)
        assert all(n == tokens(text[a:b]) <= p1.LIMIT for a, b, n in cuts)
        assert not text[: cuts[0][0]].strip() and not text[cuts[-1][1] :].strip()
        assert all(tokens(text[b[0] : a[1]]) == p1.OVERLAP for a, b in zip(cuts, cuts[1:]) if a[2] >= p1.OVERLAP)
    assert p1.pieces("") == [] and p1.pieces(" \n") == [] and len(p1.pieces("x" * 9000)) == 1


def data(spark, rng):
    blocks, orders = [], {}
    for d in range(6):
        place = 0
        for b in range(rng.choice([1, 5, 40])):
            place += rng.randrange(1, 4)
            row = (f"b{d}-{b}", f"d{d}" if d else None, place if d != 1 else None, rng.choice([None, "", " \n", text_of(rng, rng.choice([5, 90, 600, 2000]))]), "clash")
            blocks += [row] * rng.choice([1, 1, 2])
            orders.setdefault(row[1], []).append(row)
    found = [(f"d{d}", sorted({rng.randrange(0, 44) for _ in range(4)})) for d in range(7)]
    found += [found[2], ("d3", None), ("d4", []), (None, [0, 2])]
    frame = spark.createDataFrame(blocks, "block_id string, doc_id string, block_order int, text string, item_id string")
    return frame, spark.createDataFrame(found, "doc_id string, starts array<int>"), orders, found


def test_found_against_brute_force(spark):
    rng = random.Random(5)
    frame, detections, orders, found = data(spark, rng)
    chunks = [("c1", text_of(rng, 800), 1), ("c2", None, 1), ("c1", None, 1), ("c3", "word. " * 600, 1)]
    want = {("chunks", c, brute(t)) for c, t, _ in chunks if brute(t)}
    finest = ("block", *p1.KINDS)
    for doc, rows in orders.items():
        rows = sorted(rows, key=lambda r: (r[2] or 0, r[0]))
        want |= {("blocks", r[0], brute(r[3])) for r in rows if brute(r[3])}
        starts = sorted({s for d, f in found if d == doc and f for s in f})
        for a, b in zip(starts, [*starts[1:], None]):
            if sum(tokens(r[3] or "") for r in rows[a:b]) > p1.LIMIT and doc:
                want.add(("units", f"{doc}:{a}", max((brute(r[3]) or "block" for r in rows[a:b]), key=finest.index)))
    got = p1.found(frame, spark.createDataFrame(chunks, "chunk_id string, source_text string, level int"), detections)
    assert got.columns == ["item_table", "item_id", "boundary"]
    assert {tuple(r) for r in got.collect() if not r.item_id.startswith(":")} == want


def test_long_texts_go_through_ranges(spark):
    rng = random.Random(6)
    texts = {f"i{n}": text_of(rng, size) for n, size in enumerate([10, 700, 3000, 5000])} | {"long": "y" * 5000}
    frame = spark.createDataFrame([*texts.items(), ("i3", texts["i3"]), ("none", None)], "item_id string, text string")
    got = {r.item_id: [r.tokens, r.paragraph, r.line, r.sentence] for r in p1.token_sizes(frame, "item_id", "text", range_chars=900).collect()}
    assert set(got) == {*texts, "none"} and got["none"] == [0, 0, 0, 0]
    assert all(p1.boundary_of(got[i]) == brute(t) and got[i][0] == tokens(t) for i, t in texts.items())
    rows = p1.text_pieces(frame, "item_id", "text", range_chars=900).collect()
    assert {r.item_id for r in rows} == {i for i, t in texts.items() if tokens(t) > p1.LIMIT}
    for i in {r.item_id for r in rows}:
        mine = sorted((r for r in rows if r.item_id == i), key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine))) and all(r.text == texts[i][r.start_char : r.end_char] for r in mine)
        assert not texts[i][: mine[0].start_char].strip() and not texts[i][mine[-1].end_char :].strip()
        assert all(b.start_char < a.end_char < b.end_char and tokens(b.text) <= p1.LIMIT for a, b in zip(mine, mine[1:]))


def test_pieces_do_not_depend_on_ranges_or_runs(spark):
    rng = random.Random(12)
    texts = {f"i{n}": text_of(rng, size) for n, size in enumerate([513, 1400, 6000])} | {"wide": "y" * 3000 + " " + "z w " * 700}
    frame = spark.createDataFrame([*texts.items()], "item_id string, text string")
    want = {(i, n, a, b, k, t[a:b]) for i, t in texts.items() if tokens(t) > p1.LIMIT for n, (a, b, k) in enumerate(p1.pieces(t))}
    for size in (500, 2_900, 1 << 20):
        assert {tuple(r) for r in p1.text_pieces(frame, "item_id", "text", range_chars=size).collect()} == want
    blocks, detections, _, _ = data(spark, random.Random(8))
    one, other = ({tuple(r) for r in p1.unit_pieces(blocks, detections, run_blocks=n).collect()} for n in (3, 1_000))
    assert one == other and one


def test_files_are_read_in_byte_ranges(spark, tmp_path):
    rng = random.Random(21)
    texts = {f"f{n}": text_of(rng, size) for n, size in enumerate([600, 4000, 20])} | {"wide": "ÿ" * 3000 + " " + "ž w " * 700, "none": "", "dense": "x" * 20_000}
    rows = []
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
        rows.append((str(tmp_path / name), len(text.encode())))
    want = {(str(tmp_path / i), n, a, b, k, t[a:b]) for i, t in texts.items() if tokens(t) > p1.LIMIT for n, (a, b, k) in enumerate(p1.pieces(t))}
    files = spark.createDataFrame(rows, "path string, size long")
    for size in (333, 5_000, 1 << 20):
        assert {tuple(r) for r in p1.file_pieces(files, size).collect()} == want
    assert p1.file_pieces(files.limit(0)).count() == 0


def test_units_and_empty_tables(spark):
    frame, detections, orders, found = data(spark, random.Random(8))
    rows = p1.unit_pieces(frame, detections).collect()
    assert rows and all(r.tokens == tokens(r.text) <= p1.LIMIT for r in rows)
    none = p1.all_pieces(frame.limit(0), spark.createDataFrame([], "chunk_id string, source_text string"), detections)
    assert none.count() == 0
    assert p1.found(frame.limit(0), spark.createDataFrame([], "chunk_id string, source_text string"), detections).count() == 0
