"""Attack rows against an episode simulator."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from netlume.operators import dos, tagging

from .packets_of import ICMP, packets


def tagged(spark, *fields):
    return tagging.tag(packets(spark, *fields))


def simulate(rows, seconds=60, window=60, slide=10):
    """(protocol, target, interval) to sums, from packets one after another."""
    out, vectors = {}, {}
    for ts, protocol, target, dst, attack_port, target_port, size, miss in sorted(rows):
        key, own = (protocol, target), ts - ts % seconds
        v = vectors.get(key)
        if v is None or own > v["interval"] + seconds:
            v = vectors[key] = {"interval": own, "start": ts, "n": 0, "size": 0, "miss": 0, "ppm": 0, "buckets": defaultdict(int), "nets": set(), "ap": set(), "tp": set()}
        v["interval"] = own
        v["n"] += 1
        v["size"] += size
        v["miss"] += miss
        v["nets"].add(dst >> 16)
        v["ap"].add(attack_port)
        v["tp"].add(target_port)
        bucket = ts - ts % slide
        v["buckets"][bucket] += 1
        v["ppm"] = max(v["ppm"], sum(n for b, n in v["buckets"].items() if bucket - window < b <= bucket))
        out[*key, own] = (len(v["nets"]), len(v["ap"]), len(v["tp"]), v["n"], v["miss"], v["size"], v["ppm"], v["start"], ts)
    return out


def test_episodes_of_random_packets(spark):
    rng = random.Random(4)
    fields, rows = [], []
    for _ in range(1500):
        ts, target, dst, size = 6000 + int(rng.triangular(0, 1500, 200)), rng.randrange(4), rng.randrange(1 << 20), rng.randrange(40, 1500)
        if rng.random() < 0.6:
            a, b = rng.randrange(5), rng.randrange(5)
            fields.append({"ts_sec": ts, "src_ip": target, "dst_ip": dst, "src_port": b, "dst_port": a, "tcp_flags": rng.choice((18, 4)), "ip_len": size})
            rows.append((ts, 6, target, dst, a, b, size, 0))
        elif rng.random() < 0.5:
            a, b, p, wrong = rng.randrange(5), rng.randrange(5), rng.choice((6, 17, 1)), rng.random() < 0.3
            fields.append(ICMP | {"ts_sec": ts, "src_ip": 99, "dst_ip": dst, "src_port": 3, "dst_port": 1, "ip_len": size, "inner_dst_ip": target, "inner_src_ip": dst + wrong, "inner_protocol": p, "inner_sport": a, "inner_dport": b})
            rows.append((ts, p, target, dst, a, b, size, int(wrong)))
        else:
            fields.append(ICMP | {"ts_sec": ts, "src_ip": target, "dst_ip": dst, "src_port": 0, "dst_port": 2, "ip_len": size})
            rows.append((ts, 1, target, dst, 512, 0, size, 0))
    got = {
        (r.target_protocol, r.target_ip, r.bin_timestamp): (r.attacker_slash16_cnt, r.attack_port_cnt, r.target_port_cnt, r.packet_cnt, r.icmp_mismatches, r.byte_cnt, r.max_ppm_interval, r.start_time_sec, r.latest_time_sec)
        for r in dos.attack_rows(tagged(spark, *fields)).collect()
    }
    assert got == simulate(rows)


def burst(n, start=6000, step=1, **more):
    return [{"ts_sec": start + k * step, "tcp_flags": 18, "src_ip": 7} | more for k in range(n)]


@pytest.mark.parametrize(("fields", "found"), [
    (burst(61), True), (burst(60), False), (burst(31, step=3), False), (burst(40, step=2), True), (burst(61, tcp_flags=2), False),
    (burst(30) + [{"ts_sec": 6060, "tcp_flags": 18, "src_ip": 7}], True), (burst(24) + [{"ts_sec": 6060, "tcp_flags": 18, "src_ip": 7}], False),
])
def test_default_thresholds(spark, fields, found):
    assert (dos.attacks(tagged(spark, *fields)).count() > 0) == found


def test_idle_interval_begins_a_new_episode(spark):
    rows = dos.attack_rows(tagged(spark, *burst(3), *burst(2, 6060), *burst(5, 6180))).orderBy("bin_timestamp").collect()
    assert [(r.bin_timestamp, r.packet_cnt, r.start_time_sec) for r in rows] == [(6000, 3, 6000), (6060, 5, 6000), (6180, 5, 6180)]


def test_large_packets_begin_nothing(spark):
    assert dos.attack_rows(tagged(spark, *burst(3, caplen=20000))).count() == 0


def test_others_are_not_vectors(spark):
    quoted = ICMP | {"src_port": 3, "inner_dst_ip": 5, "inner_src_ip": 6, "inner_protocol": 47}
    assert dos.vectors(packets(spark, quoted, ICMP | {"src_port": 3}, ICMP | {"src_port": 8})).count() == 0


def test_thresholds():
    assert dos.Thresholds(slide=100).slide == 60
    with pytest.raises(ValueError):
        dos.Thresholds(window=60, slide=7)


def test_first_packet_and_place(spark):
    df = tagged(spark, *burst(2, l2_bytes=b"abc", src_port=80, dst_port=9)).withColumn("maxmind", F.struct(F.lit("EU").alias("continent"), F.lit("DE").alias("country")))
    r = dos.attack_rows(df).first()
    assert (bytes(r.initial_packet), r.initial_packet_len, r.first_attack_port, r.first_target_port, r.maxmind_continent, r.maxmind_country) == (b"abc", 60, 9, 80, "EU", "DE")
