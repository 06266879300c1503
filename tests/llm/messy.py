"""A small table with all that the operators must withstand."""

from __future__ import annotations

import random

EXTRA = ["key", "sig", "ident", "part", "votes", "x", "tokens", "block", "family", "component", "n", "_c0", "_piece", "bucket", "shard", "items", "spans", "word", "code", "rep", "quality"]


def texts(seed: int = 7) -> list[tuple[int | None, str | None]]:
    """(doc_id, text) with distinct ids, and rows whose id is null."""
    r = random.Random(seed)
    vocabulary = ["the", "of", "and", "Élan", "straße", "señor", "to"] + ["".join(r.choice("abcdeghilnorst") for _ in range(r.randint(2, 9))) for _ in range(150)]

    def prose(n):
        out = []
        for _ in range(n):
            out.append(r.choice(vocabulary) + ("." if r.random() < 0.1 else ""))
            out.append("\n" if r.random() < 0.06 else " ")
        return "".join(out).strip()

    base, header, passage = prose(120), "This very line stands in many documents.", prose(70)
    rows: list[tuple[int | None, str | None]] = [(0, None), (1, ""), (2, " \n\t "), (3, "one two"), (4, "ONE  two\n"), (5, "x"), (6, "\n\n"), (7, "\x00 nul \x0b tab"), (8, "日本語 テキスト " * 30)]
    at = 10
    for k in range(12):
        w = base.split(" ")
        for _ in range(k % 4):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        rows.append((at + k, " ".join(w)))
    at += 12
    rows += [(at + k, f"{header}\n{prose(40)}\n  {header.upper()}\t\n{prose(10)}") for k in range(6)]
    at += 6
    rows += [(at + k, f"{prose(30)} {passage} {prose(30)}") for k in range(5)]
    at += 5
    rows += [(at, base), (at + 1, base), (at + 2, prose(4000)), (at + 3, "same word " * 2500), (at + 4, "### $$$ " * 90), (at + 5, prose(60).upper() + "!!!")]
    at += 6
    rows += [(at + k, prose(r.randint(1, 90))) for k in range(40)]
    rows += [(None, base), (None, None), (-5, passage), (2**40, passage + " end")]
    return rows


ITEMS = [(1, "ONE two"), (2, None), (3, ""), (4, "straße")]


def frame(spark, rows, table="doc_id long, text string"):
    """The rows with more columns, whose names the operators use themselves, and some of them null."""
    df = spark.createDataFrame(rows, table).repartition(3)
    for k, name in enumerate(EXTRA):
        if name not in df.columns:
            df = df.selectExpr("*", f"if({k} % 2 = 0, null, 'clash') as `{name}`")
    text = "text" if "text" in df.columns else "null"
    return df.selectExpr("*", "'xx' as lang", "cast(null as string) as source", f"cast(length({text}) as long) as n_chars")
