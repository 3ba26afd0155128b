import itertools
import random

import brute
from pyspark.sql import functions as F

HARD = [
    None,
    "",
    "a@b.c_d@e.f a@b.com.x@y.z @x.y a@b a@b. a@b..c",
    "1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.4 1..2.3.4 12.3.4",
    "4336147440738033 4336-1474-4073-8033 4336 1474 4073 8033 4336  1474 1234567890123 0000000000000",
    "+1 (778) 555-8933 +1 2 + 12345678 +49..89-1234567) +123456789012345678 ++15551234567",
    "é😀 bosbt.42@mail8.example.com ü 69.228.100.194 ñ +1 (722) 555-6978.",
    "x" * 5000 + "@" + "a." * 4000 + "b",
    "1" * 20000,
    "1-" * 9000,
    "+" + "1 " * 9000,
    " ".join(["a1@b2.cd"] * 700),
    "call (415) 555-2671 or SSN 123-45-6789, Dear Mr. John Smith, IBAN DE89 3704 0044 0532 0130 00",
    "token = 531d33d281ee7945b4ffb358ababf877ac2efa08",
]


def texts():
    rng = random.Random(5)
    alphabet = "a1.@-+ ()_2é😀"
    return HARD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(5, 120))) for _ in range(600)]


def test_base_spans_equal_plain_matching(shipped):
    from querent.llm.pii import find

    rows = [(i, t) for i, t in enumerate(texts())]
    df = shipped.createDataFrame(rows, "doc_id long, text string").withColumn("found", F.lit("clash")).withColumn("base", F.lit(1))
    got = {r.doc_id: r for r in find(df).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        want = brute.base_spans(t)
        r = got[i]
        assert r.base_sha256 == brute.base_digest(t), (t or "")[:80]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in want) for x in ("email", "ip", "card", "phone")]
        listed = brute.listed(want)
        assert r.spans == listed or r.spans.startswith(listed + "," if listed else "")


def test_redaction_and_empty_table(shipped):
    from querent.llm.pii import find, redact

    df = shipped.createDataFrame([(1, "write a.b@mail.example.com or +1 (722) 555-6978 now"), (2, None), (3, "plain")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in redact(df).collect()}
    assert got == {1: "write <email> or <phone> now", 2: None, 3: "plain"}
    assert find(df.limit(0)).count() == 0


def test_expectation_maximisation_finds_the_better_voter():
    from querent.llm.pii import reliabilities

    # voters are right in 9, 5, 8 and 7 of 10
    right, table = (0.9, 0.5, 0.8, 0.7), []
    for truth in (1, -1):
        for hits in itertools.product((True, False), repeat=4):
            count = 1000.0
            for h, p in zip(hits, right):
                count *= p if h else 1 - p
            table.append((tuple(truth if h else -truth for h in hits), count))
    share, given, _ = reliabilities(table)
    assert abs(share - 0.5) < 0.05
    assert all(abs(given[voter, 1][0] - p) < 0.05 for voter, p in enumerate(right))
