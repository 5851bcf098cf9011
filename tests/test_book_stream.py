import random

import pytest

from tallyloom.streaming import book_stream as bs, ledger_stream as ls

SCHEMA = "ledger long, place int, what string, removed boolean, selling string, buying string, id long, amount long, n long, d long, reserve_a long, reserve_b long"


def offer(ledger, place, id_, pair, amount=None, n=None, d=None):
    return (ledger, place, "offer", amount is None, *pair, id_, amount, n, d, None, None)


def pool(ledger, place, pair, a=None, b=None):
    return (ledger, place, "pool", a is None, *pair, None, None, None, None, a, b)


def run(spark, folder, tmp_path, batches):
    """One more start of the stream, over one more file for each batch."""
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    bs.run_book(stream, path=str(tmp_path / "changes"), checkpoint=str(tmp_path / "cp"), parts=3)


def book(spark, tmp_path):
    cp = str(tmp_path / "cp")
    levels = {(r.selling, r.buying, r.n, r.d): (r.offers, int(r.amount)) for r in bs.book_levels(spark, cp).collect()}
    offers = {r.id: (r.selling, r.buying, r.amount, r.n, r.d) for r in bs.book_offers(spark, cp).collect()}
    pools = {(r.selling, r.buying): (r.reserve_a, r.reserve_b) for r in bs.book_pools(spark, cp).collect()}
    return levels, offers, pools


def expected(rows):
    offers, pools = {}, {}
    for r in sorted(rows, key=lambda r: r[:2]):
        _, _, what, removed, s, b, id_, amount, n, d, ra, rb = r
        if what == "pool":
            pools[s, b] = (ra, rb)
            if removed:
                del pools[s, b]
        elif removed:
            offers.pop(id_, None)
        else:
            offers[id_] = (s, b, amount, n, d)
    levels = {}
    for s, b, amount, n, d in offers.values():
        k = next(k for k in levels if k[:2] == (s, b) and k[2] * d == n * k[3]) if any(k[:2] == (s, b) and k[2] * d == n * k[3] for k in levels) else (s, b, n, d)
        held = levels.get(k, (0, 0))
        levels[k] = (held[0] + 1, held[1] + amount)
    return levels, offers, pools


X, Y = ("x", "y"), ("y", "x")


def test_a_book_that_stops_and_goes_on(spark, tmp_path):
    folder = str(tmp_path / "in")
    one = [offer(1, 0, 1, X, 10, 1, 2), offer(1, 1, 2, X, 20, 2, 4), offer(1, 2, 3, Y, 5, 3, 1), pool(1, 3, X, 100, 200)]
    two = [offer(2, 0, 1, X, 15, 1, 3), offer(2, 1, 9, X), offer(3, 0, 2, X), pool(3, 1, Y, 7, 8)]  # one that is not there goes too
    run(spark, folder, tmp_path, [one])
    levels, offers, pools = book(spark, tmp_path)
    assert levels == {("x", "y", 1, 2): (2, 30), ("y", "x", 3, 1): (1, 5)} and set(offers) == {1, 2, 3} and pools == {X: (100, 200)}
    run(spark, folder, tmp_path, [two])
    levels, offers, pools = book(spark, tmp_path)
    assert levels == {("x", "y", 1, 3): (1, 15), ("y", "x", 3, 1): (1, 5)} and set(offers) == {1, 3} and pools == {X: (100, 200), Y: (7, 8)}
    run(spark, folder, tmp_path, [[pool(4, 0, X), offer(4, 1, 4, X, 2**62, 1, 3), offer(4, 2, 5, X, 2**62, 1, 3)]])
    levels, _, pools = book(spark, tmp_path)
    assert levels["x", "y", 1, 3] == (3, 2**63 + 15) and pools == {Y: (7, 8)}  # sums pass 64 bits
    changes = ls.ordered_rows(spark, str(tmp_path / "changes"))
    assert changes.where("selling = 'x' and n = 1 and d = 2 and offers = 0").count() >= 1
    with pytest.raises(Exception, match="comes after 4|goes back from 4 to 4"):
        run(spark, folder, tmp_path, [[offer(4, 9, 6, X, 1, 1, 1)]])


def test_what_is_behind_another_pair_is_refused_too(spark, tmp_path):
    folder = str(tmp_path / "in")
    run(spark, folder, tmp_path, [[offer(7, 0, 1, X, 10, 1, 2)]])
    with pytest.raises(Exception, match="goes back from 7 to 6"):
        run(spark, folder, tmp_path, [[offer(6, 0, 2, ("u", "v"), 10, 1, 2), offer(9, 0, 3, ("u", "v"), 10, 1, 2)]])


def test_many_batches_like_a_plain_replay(spark, tmp_path):
    rng, folder, every = random.Random(3), str(tmp_path / "in"), []
    for start in range(2):
        batches = []
        for b in range(2):
            ledger = 1 + 10 * (2 * start + b)
            rows = []
            for k in range(60):
                i = rng.randrange(25)
                pair = [X, Y, ("x", "z")][i % 3]
                at = (ledger + rng.randrange(9), k)
                if rng.random() < 0.1:
                    rows.append(pool(*at, pair, rng.randrange(1, 50), 5))
                else:
                    rows.append(offer(*at, i, pair, *((rng.randrange(1, 50), rng.randrange(1, 4), rng.randrange(1, 4)) if rng.random() < 0.7 else ())))
            batches.append(rows)
            every += rows
        run(spark, folder, tmp_path, batches)
    levels, offers, pools = book(spark, tmp_path)
    want_levels, want_offers, want_pools = expected(every)
    assert offers == want_offers and pools == want_pools
    assert {(s, b, n / d): v for (s, b, n, d), v in levels.items()} == {(s, b, n / d): v for (s, b, n, d), v in want_levels.items()}
