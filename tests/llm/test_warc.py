import base64
import hashlib
import random

import pytest

from stratalens.llm import warc

PAYLOADS = [b"", b"<html>one</html>", "é中".encode() * 500, b"WARC/1.1\r\nWARC-Type: response\r\n\r\n", b"\x1f\x8b\x08 in text", b"x" * 100_000]


def records():
    return [warc.record("response", p, page_id=i, uri=f"http://e.com/{i}") for i, p in enumerate(PAYLOADS)] + [warc.record("revisit", PAYLOADS[1], page_id=9, refers_to=1)]


def ids(found):
    return [int(x[3]["head"]["x-page"]) for x in found if x[0] == "record"]


def covered(found, n):
    """Offsets and lengths tile the file; records of one member share theirs."""
    spans = sorted({(x[1], x[2]) for x in found})
    at = 0
    for a, length in spans:
        assert a == at
        at += length
    assert at == n


@pytest.mark.parametrize("zipped", [True, False])
def test_round_trip(zipped):
    data = b"".join(warc.member(r) if zipped else r for r in records())
    found = list(warc.salvage(data))
    assert ids(found) == [0, 1, 2, 3, 4, 5, 9] and not [x for x in found if x[0] == "gap"]
    assert [x[3]["payload"] for x in found][:6] == PAYLOADS
    assert found[-1][3]["payload_bytes"] == len(PAYLOADS[1]) and found[-1][3]["payload_digest"] == warc.digest(PAYLOADS[1])
    covered(found, len(data))


@pytest.mark.parametrize("zipped", [True, False])
@pytest.mark.parametrize("seed", range(25))
def test_damage(zipped, seed):
    r = random.Random(seed)
    parts = [warc.member(x) if zipped else x for x in records()]
    hurt = r.randrange(len(parts))
    p = bytearray(parts[hurt])
    how = r.choice(["flip", "cut", "insert", "zero"])
    # a plain record's header lines carry no checksum of their own: hit its start or its block
    at = r.randrange(len(p)) if zipped else r.choice([0, r.randrange(p.index(b"\r\n\r\n"), len(p))])
    if how == "flip":
        p[at] ^= 1 << r.randrange(8)
    elif how == "cut":
        del p[at : at + r.randint(1, 50)]
    elif how == "insert":
        p[at:at] = bytes(r.randrange(256) for _ in range(r.randint(1, 50)))
    else:
        p[at : at + 20] = b"\0" * len(p[at : at + 20])
    data = b"".join(parts[:hurt]) + bytes(p) + b"".join(parts[hurt + 1 :])
    found = list(warc.salvage(data))
    own = [0, 1, 2, 3, 4, 5, 9]
    got = ids(found)
    assert [x for x in got if x != own[hurt]] == own[:hurt] + own[hurt + 1 :]
    if own[hurt] not in got:
        assert any(x[0] == "gap" for x in found)
    covered(found, len(data))


def test_whole_file_member_and_junk():
    inner = b"".join(records())
    assert len(ids(list(warc.salvage(warc.member(inner))))) == 7
    half = warc.member(inner)
    found = list(warc.salvage(half[: len(half) - 200] + warc.member(records()[1])))
    assert ids(found)[-1] == 1 and any(x[0] == "gap" for x in found)
    found = list(warc.salvage(b"junk\n" + warc.member(records()[1]) + b"tail"))
    assert ids(found) == [1] and [(x[1], x[2]) for x in found if x[0] == "gap"][0] == (0, 5)
    assert list(warc.salvage(b"")) == []


def brute(rows, least=0):
    groups = {}
    for i, h in rows:
        groups.setdefault((h or "").encode(), []).append(i)
    out = []
    for i, h in rows:
        p = (h or "").encode()
        known = [x for x in groups[p] if x is not None]
        top = max(known, default=None)
        again = len(groups[p]) > 1 and top is not None and i != top and len(p) >= least
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", top if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 4])
def test_pages(spark, least):
    rows = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "long é payload"), (6, "long é payload"), (6, "long é payload"), (None, "long é payload"), (None, "n" * 9), (None, "n" * 9), (7, "WARC/1.1\r\n\r\n"), (8, "q" * 200_000)]
    d = spark.createDataFrame([(i, h, "u" if i != 5 else None, "x") for i, h in rows], "page_id long, html string, url string, kind string").repartition(3)
    got = warc.round_trip(d, least_bytes=least)
    assert got.filter("kind = 'gap'").count() == 0
    assert sorted(map(tuple, got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str) == brute(rows, least)


def test_empty_table(spark):
    d = spark.createDataFrame([], "page_id long, html string, url string")
    assert warc.round_trip(d).count() == 0


def test_query(spark, sf_dir):
    from stratalens.llm.queries import op2_warc

    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html").collect()]
    assert sorted(map(tuple, op2_warc(spark, sf_dir).collect()), key=str) == brute(rows)
