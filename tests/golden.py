"""The 25-word example sentence of the CoNLL-2009 corpus format."""

WORDS = """1 The the DT 2 NMOD _ _ _ _ _ _
2 economy economy NN 4 NMOD _ _ A1 _ _ _
3 's 's POS 2 SUFFIX _ _ _ _ _ _
4 temperature temperature NN 5 SBJ Y temperature.01 A2 A1 _ _
5 will will MD 0 ROOT _ _ _ AM-MOD _ _
6 be be VB 5 VC _ _ _ _ _ _
7 taken take VBN 6 VC Y take.01 _ _ _ _
8 from from IN 7 ADV _ _ _ A2 _ _
9 several several DT 11 NMOD _ _ _ _ _ _
10 vantage vantage NN 11 NMOD _ _ _ _ A1 _
11 points point NNS 8 PMOD Y point.02 _ _ _ _
12 this this DT 13 NMOD _ _ _ _ _ _
13 week week NN 7 TMP _ _ _ AM-TMP _ _
14 , , , 7 P _ _ _ _ _ _
15 with with IN 7 ADV _ _ _ AM-ADV _ _
16 readings reading NNS 15 PMOD Y reading.01 _ _ _ _
17 on on IN 16 NMOD _ _ _ _ _ A1
18 trade trade NN 17 PMOD _ _ _ _ _ _
19 , , , 18 P _ _ _ _ _ _
20 output output NN 18 COORD _ _ _ _ _ _
21 , , , 20 P _ _ _ _ _ _
22 housing housing NN 20 COORD _ _ _ _ _ _
23 and and CC 22 COORD _ _ _ _ _ _
24 inflation inflation NN 23 CONJ _ _ _ _ _ _
25 . . . 5 P _ _ _ _ _ _"""


def rows():
    return [line.split() for line in WORDS.split("\n")]


def conll():
    """Text with gold and predicted columns alike."""
    lines = []
    for i, form, lemma, pos, head, rel, fill, pred, *roles in rows():
        lines.append("\t".join([i, form, lemma, lemma, pos, pos, "_", "_", head, head, rel, rel, fill, pred, *roles]))
    return "\n".join(lines) + "\n\n"


def tokens(spark, extra=()):
    """The sentence as sent_id 1, and two roots as sent_id 2, plus extra rows."""
    data = [(1, int(i), form, lemma, pos, int(head), rel, fill, pred) for i, form, lemma, pos, head, rel, fill, pred, *_ in rows()]
    data += [(2, 1, "a", "a", "NN", 0, "R", "_", "_"), (2, 2, "b", "b", "VB", 1, "S", "_", "_"),
             (2, 3, "c", "c", "NN", 0, "R", "_", "_"), (2, 4, "d", "d", "VB", 3, "S", "Y", "d.01"), *extra]
    return spark.createDataFrame(
        data, "sent_id long, word_id int, form string, lemma string, pos string, head int, deprel string, fillpred string, pred string"
    )


def args(spark):
    found = [(1, n, int(r[0]), role) for r in rows() for n, role in enumerate(r[8:], 1) if role != "_"]
    return spark.createDataFrame(found, "sent_id long, pred_no int, word_id int, role string")
