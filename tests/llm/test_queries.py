"""Registered queries against independent plain Python."""

import hashlib
import json
import random
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from conftest import SMALL

from gristmill.llm import media, secrets, url_filter


MID = SMALL.replace("0.001", "0.01")


def table(name, folder=SMALL):
    return pq.read_table(f"{folder}/{name}.parquet").to_pylist()


def test_secret_query(spark):
    assign = re.compile(r"(?i:(?:password|passwd|secret|token|api_key|apikey))[\"']?[ ]*[:=][ ]*[\"']?([A-Za-z0-9+/_.=-]+)", re.A)
    got = {r.doc_id: r for r in secrets.op9_secret_scan(spark, MID).collect()}
    assert set(got) == {d["doc_id"] for d in table("documents", MID)}
    found = 0
    for d in table("documents", MID):
        text, r = d["text"] or "", got[d["doc_id"]]
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[1]) >= 8]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 16]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 32]
        base = [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans)]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == n for _, k, _ in spans) for n in range(3))
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest() and set(base) <= set(r.spans.split(","))
        found += len(base)
    assert found


def mixed(depth):
    out = "&#61;"
    for _ in range(depth):
        out = "%26" + out[1:] if out[0] == "&" else "&#37;" + out[1:]
    return out


@pytest.mark.parametrize("escape", ["%" + "25" * 8000 + "3d", "\\" + "u005c" * 3000 + "u003d", "\\" + "x5c" * 4000 + "x3D", "&" + "amp;" * 4000 + "#61;", mixed(3000)])
def test_deep_escapes_cost_their_length(escape):
    text = f"see password{escape}hunter2hunter2 end"
    began = time.process_time()
    spans = secrets.find(text)[1]
    assert time.process_time() - began < 1.0
    assert ("assign", 4, len(text) - 4) in spans


def test_escapes_settle_as_step_by_step():
    rng = random.Random(3)
    bits = ["%25", "%41", "%3d", "&amp;", "&#37;", "&lt", ";", "\\u0025", "u0041", "\\x5c", "x41", "\\", "%", "2", "5", "a", "é", "%C3%A9", "%25C3", "%25A9", "\\u{5c}", "u{41}"]
    for _ in range(400):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 12)))
        layer = step = secrets.Layer(text, [(0, 0, len(text), True)])
        while (new := secrets.unescape(step)) is not None:
            step = new
        once = layer
        while (new := secrets.settled(once)) is not None:
            once = new
        assert once.text == step.text, text
        assert all(0 <= once.span(k, k + 1)[0] < once.span(k, k + 1)[1] <= len(text) for k in range(len(once.text)))


def boxes(data, start=0, end=None):
    """name to body of the boxes, those of known containers too."""
    out, end = {}, len(data) if end is None else end
    while start < end:
        size, name = int.from_bytes(data[start : start + 4], "big"), data[start + 4 : start + 8].decode()
        out[name] = data[start + 8 : start + size]
        if name in ("moov", "trak", "mdia", "minf", "stbl"):
            out |= boxes(data, start + 8, start + size)
        start += size
    return out


def test_media_query_against_its_boxes(spark):
    number = lambda b, at: int.from_bytes(b[at : at + 4], "big")
    files = {r.doc_id: r for r in media.store_texts(spark.read.parquet(f"{SMALL}/documents.parquet")).collect()}
    texts = {d["doc_id"]: d["text"].encode() for d in table("documents")}
    for r in media.op6_media_columns(spark, SMALL).collect():
        data, payload = files[r.doc_id].media, texts[r.doc_id] + bytes(-len(texts[r.doc_id]) % 64)
        found = boxes(data)
        assert (r.media_bytes, r.media_sha256) == (len(data), hashlib.sha256(data).hexdigest()) and found["mdat"] == payload
        units, keys = number(found["stsz"], 8), [number(found["stss"], 8 + 4 * k) for k in range(number(found["stss"], 4))]
        chunks = [number(found["stco"], 8 + 4 * k) for k in range(number(found["stco"], 4))]
        places = [chunks[(k - 1) // 256] + (k - 1) % 256 * 64 for k in keys]
        assert [(k.start, k.end) for k in r.keyframes] == [(p, p + 64) for p in places] and data[places[-1] : places[-1] + 64] == payload[(keys[-1] - 1) * 64 : keys[-1] * 64]
        rate, seconds = number(found["mdhd"], 20), int.from_bytes(found["mdhd"][24:32], "big") / number(found["mdhd"], 20)
        assert (r.codec, r.samples, r.seconds) == ("raw", units, seconds) == (found["stsd"][12:16].decode().strip(), len(payload) // 64, len(payload) / rate)
        crc = zlib.crc32(b"".join(p.to_bytes(8, "little") + (p + 64).to_bytes(8, "little") for p in places))
        assert r.feature == f"raw/{rate} duration={len(payload)} samples={units} keyframes={len(keys)} ranges={crc:08x}"
    (columns,) = media.media_columns(spark.createDataFrame([(1, bytearray(files[min(files)].media))], "doc_id long, media binary")).collect()
    assert [tuple(k) for k in columns.keyframes] == [tuple(k) for k in files[min(files)].keyframes]


def test_verdicts_of_a_graph(spark):
    """300 hosts, a slow cycle of 40 among them, against dense power iteration."""
    rng = random.Random(11)
    hosts = [f"h{k}.net" for k in range(260)] + [f"c{k}.net" for k in range(40)]
    links = {(rng.choice(hosts[:260]), rng.choice(hosts)) for _ in range(700)} | {(f"c{k}.net", f"c{(k + 1) % 40}.net") for k in range(40)} | {("c0.net", "h1.net")}
    good, bad = [f"good{k}.com" for k in range(4)], [f"bad{k}.com" for k in range(5)]
    links |= {(g, rng.choice(hosts)) for g in good for _ in range(3)} | {(rng.choice(hosts), b) for b in bad for _ in range(4)} | {("good0.com", "c0.net"), ("c20.net", "bad0.com")}
    links = {(a, b) for a, b in links if a != b}
    out = defaultdict(list)
    for a, b in sorted(links):
        out[a].append(b)
    pages = [(h, f"https://{h}/x", "".join(f'<a href="https://{b}/y">' for b in out[h])) for h in hosts]
    pages += [(h, f"http://{h}/fr/1", "".join(f'<a href="//{b}/y">' for b in out[h])) for h in good] + [(h, f"http://{h}/de/1", None) for h in bad]
    rows = [(k, *p[1:]) for k, p in enumerate(pages)]
    got = {r.host: r for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    names = sorted({*hosts, *good, *bad})
    place = {h: k for k, h in enumerate(names)}

    def rank(edges, seeds):
        move, seed = np.zeros((len(names), len(names))), np.zeros(len(names))
        many = defaultdict(int)
        for a, _ in edges:
            many[a] += 1
        for a, b in edges:
            move[place[b], place[a]] += 1 / many[a]
        seed[[place[h] for h in seeds]] = 1 / len(seeds)
        score = seed
        for _ in range(2000):
            moved = 0.85 * move @ score
            score = moved + (1 - moved.sum()) * seed
        return score

    trust, distrust = rank(links, good), rank({(b, a) for a, b in links}, bad)
    wrong = [h for h in hosts if abs(trust[place[h]] - distrust[place[h]]) > 1e-4 * trust[place[h]] and got[h].verdict != ("block" if distrust[place[h]] > trust[place[h]] else "allow")]
    assert not wrong and len({got[h].verdict for h in hosts}) == 2
    assert all(abs(got[h].trust - trust[place[h]]) < 1e-5 and abs(got[h].distrust - distrust[place[h]]) < 1e-5 for h in hosts)
    assert all(got[h].verdict == "allow" for h in good) and all(got[h].verdict == "block" for h in bad) and json.dumps(got["h0.net"].rule) == "null"
