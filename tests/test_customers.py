"""Customers by gathered sets and by rows."""

import random

import pytest

from weftline.operators import graph as G


@pytest.mark.parametrize("gathered", [0, 9, 40, 10**6])
def test_customer_details_whatever_is_gathered(spark, gathered):
    draw = random.Random(3)
    rows = {(draw.randrange(8) if draw.random() < 0.6 else 99, draw.randrange(12), draw.randrange(5)) for _ in range(90)}  # one customer has most
    made = {s: s % 4 for _, s, _ in rows}
    events = spark.createDataFrame([*rows, *rows], "customer_id long, style_id long, factory_id long")
    styles = spark.createDataFrame(list(made.items()), "style_id long, factory_id long")
    got = {r.customer_id: (r.styles, r.people, r.factory_ids) for r in G.customer_details(events, styles, gathered).collect()}
    want = {}
    for c in {c for c, _, _ in rows}:
        own = {s for k, s, _ in rows if k == c}
        people = {("f", f) for _, s, f in rows if s in own} | {("c", k) for k, s, _ in rows if s in own}
        want[c] = (len(own), len(people), ",".join(map(str, sorted({made[s] for s in own}))))
    assert got == want
