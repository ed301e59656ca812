import duckdb
import pyarrow as pa

from marlstone.llm import queries, quotes

ROWS = [
    (1, 0, "user", "Hello there.\nHow do I bake   bread?\nThanks"),
    (1, 1, "assistant", "Use flour.\nAnd water."),
    (1, 2, "user", "> How do I BAKE bread?\nI also asked this\n\n> Use flour.\n> And water.\nok"),
    (1, 3, "assistant", "> > How do I bake bread?\n> I also asked this\nYes."),
    (1, 4, "user", "continuing"),
    (1, 5, "user", ">hello there.\nbranch from 0"),
    (1, 6, "user", "  > > > unknown words\n>\nplain"),
    (1, 7, "user", "> branch from 0\nnested branch? no, the message before but one"),
    (2, 0, "user", None),
    (2, 1, "assistant", ""),
    (2, 3, "user", "> Hello there.\nother conversation, and a gap"),
    (2, 3, "user", "> Hello there.\nother conversation, and a gap"),
    (3, 0, "user", "> quoting nobody"),
    (3, 1, "user", "x > y is no quote"),
    (None, 0, "user", "> lost"),
    (4, None, "user", "lost too"),
]


def write(sf_dir, rows):
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
    return sf_dir(conversations={n: pa.array(c, k) for n, c, k in zip(("conv_id", "turn", "role", "text"), cols, kinds, strict=True)} | {"reply_to": pa.array([0] * len(rows), pa.int32())})


def both(spark, path):
    got = [tuple(r) for r in queries.op1_quotation_linking(spark, path).collect()]
    names = queries.op1_quotation_linking(spark, path).columns
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{path}/conversations.parquet'")
    want = con.sql(queries.ORACLE["op1_quotation_linking"])
    return sorted(got, key=repr), sorted((tuple(dict(zip(want.columns, r, strict=True))[n] for n in names) for r in want.fetchall()), key=repr)


def test_against_oracle(spark, sf_dir):
    got, want = both(spark, write(sf_dir, ROWS))
    assert got == want
    by = {(r[0], r[1]): r for r in got}
    assert by[1, 2][6:8] == (2, 1)  # links both passages, answers the later
    assert by[1, 3][7] == 2 and by[1, 5][7] == 0 and by[1, 7][7] == 5
    order = [r[1] for r in sorted((r for r in got if r[0] == 1), key=lambda r: r[8])]
    assert order == [0, 5, 7, 6, 1, 2, 3, 4]
    assert by[1, 2][3] == "I also asked this\n\nok"


def test_empty_table(spark, sf_dir):
    got, want = both(spark, write(sf_dir, []))
    assert got == want == []


def test_long_text():
    body, n, depth, units, found = quotes.parse("> a b\n" * 50_000 + "tail")
    assert (body, n, depth) == ("tail", 1, 1) and len(found) == 2


def test_long_and_negative_turns_keep_their_order(spark, sf_dir):
    turns = [-(1 << 63) + 1, -(10**12), -12, -2, -1, 0, 5, 10**10 - 1, 10**10, 1_700_000_000_000, 1_700_000_000_001, 10**18]
    path = write(sf_dir, [(1, t, "user", f"message {t}") for t in turns])
    got = queries.op1_quotation_linking(spark, path).collect()
    paths = {r["turn"]: r["reply_path"] for r in got}
    assert sorted(paths, key=paths.get) == turns and paths[5] == "0000000005" and len(set(paths.values())) == len(turns)
