import random
import re

import pytest
from pyspark.sql import functions as F

from isoterra.llm.surrogates import KINDS, SUSPECT, _luhn, assign, canonical, mentions, replace_personal, surrogate

KEY = b"test key"
SCHEMA = "response_id long, body string"
ROWS = [
    (1, "Mail anna.berg@mail.example.com or ANNA.BERG@mail.example.com, phone +1 (017) 555-7713."),
    (2, "anna.berg@mail.example.com again; card 4111 1111 1111 1111, 4111-1111-1111-1111 and 4111111111111111"),
    (3, "host 97.51.17.173 and 10.1.2.3, not 1.2.3 nor 999.1.1.1"), (4, "Mr. Smith met Frau Müller and Mrs Smith near Mount Smith"),
    (5, None), (6, ""), (7, "nothing personal, 12 peaks at 6,190 m"), (8, "ssn 123-45-6789, IBAN DE89 3704 0044 0532 0130 00"),
    (3, "repeated id, +1 (017) 555-7713"), (None, "no id: anna.berg@mail.example.com"), (9, "x.1@a.example.com " * 4000), (10, "@ 123 only suspicious"),
    (1, "Mail anna.berg@mail.example.com or ANNA.BERG@mail.example.com, phone +1 (017) 555-7713."), (11, "Γειά Dr. Παπαδοπουλος, Mme Дубова"),
]


def test_replace_personal(spark):
    frame = spark.createDataFrame(ROWS, SCHEMA).selectExpr("response_id", "body", "1 kind", "2 canonical", "'g' gender", "4 surrogate")
    found = replace_personal(frame.repartition(2), KEY)
    assert found.columns == [*frame.columns, "entities"]
    got = found.collect()
    assert len(got) == len(ROWS)
    by_id = {}
    for r in got:
        by_id.setdefault(r["response_id"], []).append(r)
    # Nothing personal is left, and the rest of every text stays.
    originals = {(m.kind, m.canonical) for _, t in ROWS for m in mentions(t or "")}
    for key, text in ROWS:
        own = mentions(text or "")
        if len(own) > 100:
            continue
        pattern = "".join(re.escape((text or "")[a:b]) + "(.+)" for a, b in zip([0, *[m.end for m in own]], [m.start for m in own]))
        pattern += re.escape((text or "")[own[-1].end if own else 0 :])
        same = [r for r in by_id[key] if re.fullmatch(pattern, r["body"] or "", re.S)]
        assert same, (key, text, [r["body"] for r in by_id[key]])
        for m, new in zip(own, re.fullmatch(pattern, same[0]["body"] or "", re.S).groups()):
            assert (m.kind, canonical(m.kind, new)) not in originals
    assert by_id[5][0]["body"] is None and by_id[7][0]["entities"] == {} and by_id[9][0]["entities"] == {"email": 4000}
    # One entity has one surrogate in every spelling and text, in the format of the mention.
    cards = re.findall(r"\d{4}([ -]?)(\d{4})[ -]?(\d{4})[ -]?(\d{4})", by_id[2][0]["body"])
    assert [c[0] for c in cards] == [" ", "-", ""] and len({c[1:] for c in cards}) == 1
    mails = [re.search(r"[\w.]+@[\w.]+", r["body"])[0] for r in (by_id[1][0], by_id[2][0], by_id[None][0])]
    assert len({m.lower() for m in mails}) == 1 and mails[0].endswith(".com")
    assert re.search(r"phone \+\d \(\d{3}\) \d{3}-\d{4}\.", by_id[1][0]["body"])
    # Names keep their form of address, gender and script; a place is no person.
    man, woman, wife = re.fullmatch(r"Mr\. (\S+) met Frau (\S+) and Mrs (\S+) near Mount Smith", by_id[4][0]["body"]).groups()
    assert man[-1] in "nrs" and woman.endswith("a") and wife.endswith("a") and len({man, woman, wife}) == 3
    assert re.fullmatch(r"Γειά Dr\. [Ͱ-Ͽ]+, Mme [Ѐ-ӿ]+", by_id[11][0]["body"])


def test_distinct_even_in_a_small_format(spark):
    # Few formats are left for each first digit, so draws clash.
    entities = [("phone", f"{n:03d}", "") for n in range(0, 1000, 20)]
    rows = assign(spark.createDataFrame(entities, "kind string, canonical string, gender string").repartition(4), KEY).collect()
    new = [r["surrogate"] for r in rows]
    assert len(rows) == len(set(new)) == 50 and not set(new) & {c for _, c, _ in entities}
    crowded = spark.createDataFrame([("phone", str(n), "") for n in range(10)], "kind string, canonical string, gender string")
    with pytest.raises(ValueError, match="no distinct"):
        import isoterra.llm.surrogates as module

        draws, module.MOST_DRAWS = module.MOST_DRAWS, 2
        try:
            assign(crowded, KEY)
        finally:
            module.MOST_DRAWS = draws


def test_short_names_never_run_out(spark):
    # More names after titles of men than the 5,418 surrogates of one or two Latin syllables.
    names = [f"{a}{b}{c}" for a in "bcdfghjklmnpqrstvwxz" for b in "abcdefghijklmnopqrst" for c in "uvwxyzaeiopqrst"]
    frame = spark.createDataFrame([("name", n, "m") for n in names], "kind string, canonical string, gender string")
    import isoterra.llm.surrogates as module

    draws, module.MOST_DRAWS = module.MOST_DRAWS, 12
    try:
        new = [r["surrogate"] for r in assign(frame.repartition(4), KEY).collect()]
    finally:
        module.MOST_DRAWS = draws
    assert len(names) == len(set(names)) == len(new) == len(set(new)) == 6000 and not set(new) & set(names)


def test_every_entity_is_suspicious(spark):
    numbers = ["+49 30 12 34 56 78", "+45 12 34 56 78", "41 11 11 11 11 11 11 11", "+٤٩ ٣٠ ١٢ ٣٤ ٥٦ ٧٨", "१.२.३.४", "(12) 345-6789", "4-1-1-1-1-1-1-1-1-1-1-1-1"]
    numbers += ["AB12 CDEF GHIJ", "१२३-४५-६७८९", "+𞅀𞅁 𞅂𞅃", "+1 23 45", "𞓰𞓱𞓲-𞓳𞓴-𞓵𞓶𞓷𞓸"]
    names = ["王明", "محمد", "ärger", "דוד", "さくら", "민수", "ჯონი", "Ωmega", "ǅabc", "ªbc", "Āb"]
    draw, texts = random.Random(5), [*numbers, *[f"Dr {n}" for n in names], *[f"Sra. {n}" for n in names]]
    for _ in range(40_000):
        letters = draw.choice(("0123456789+-(). ", "01٠१ -.+()AZ", "AZ09 a@.-", "ÄéΩж王 DrMs."))
        texts.append("".join(draw.choice(letters) for _ in range(draw.randint(5, 24))))
        texts.append(f"{draw.choice(('Dr', 'Mme.', 'Sir'))} {chr(draw.choice((draw.randrange(0x41, 0x3000), draw.randrange(0x10000, 0x1F000))))}b")
    texts = [t for t in texts if mentions(t)]
    assert len(texts) > 5000 and all(any(n in t for t in texts) for n in numbers[:7] + names)
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in frame.where(~F.col("t").rlike(SUSPECT)).collect()] == []


def test_numbers_and_names_of_other_scripts(spark):
    rows = [(1, "call +49 30 12 34 56 78"), (2, "123 and +49 30 12 34 56 78, also +٤٩ ٣٠ ١٢ ٣٤ ٥٦ ٧٨"), (3, "Dr 王明"), (4, "Dr محمد and Dr 王明")]
    got = dict(replace_personal(spark.createDataFrame(rows, SCHEMA), KEY).select("response_id", "body").collect())
    number = got[1].removeprefix("call ")
    assert re.fullmatch(r"\+4\d \d\d \d\d \d\d \d\d \d\d", number) and number != "+49 30 12 34 56 78"
    assert got[2] == f"123 and {number}, also {number.translate(str.maketrans('0123456789', '٠١٢٣٤٥٦٧٨٩'))}"
    assert re.fullmatch(r"Dr [㐀-鿿]+", got[3]) and re.fullmatch(rf"Dr [ؠ-ۿ]+ and {got[3]}", got[4]) and "王明" not in got[3]


def test_formats():
    draw = random.Random(1)
    for n in range(200):
        digits = "".join(draw.choice("0123456789") for _ in range(15))
        card = digits + str(-_luhn(digits + "0") % 10)
        new = surrogate(KEY, "card", card, attempt=n)
        assert len(new) == 16 and _luhn(new) % 10 == 0 and new[0] == card[0]
    iban = surrogate(KEY, "iban", "DE89370400440532013000")
    assert iban[:2] == "DE" and int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert surrogate(KEY, "ip", "10.1.2.3").startswith("10.") and surrogate(KEY, "ip", "192.168.1.2").startswith("192.168.")
    a, b = surrogate(KEY, "email", "x.1@mail.example.com"), surrogate(KEY, "email", "y@mail.example.com")
    assert a.split("@")[1] == b.split("@")[1] and a != b and a != surrogate(b"other", "email", "x.1@mail.example.com")
    assert {m.kind for _, t in ROWS for m in mentions(t or "")} == set(KINDS)


def test_empty(spark):
    assert replace_personal(spark.createDataFrame([], SCHEMA), KEY).count() == 0
