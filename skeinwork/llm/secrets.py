"""Secrets in texts: fixed patterns, and random-looking strings told from identifiers by two character Markov models.

Each model gives the chance of a character after the two before it. A candidate's score is the mean log-likelihood ratio of a
character under the model of random strings and under that of ordinary identifiers. Both models are trained from labelled
samples, of which a small table is kept here; any other may be given.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from skeinwork.llm import common

KINDS = ("assign", "access", "hex")
#: The kind of a span that the models add.
RANDOM = "random"
#: Over lower-cased bytes, which keep their places.
_ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"(?<![0-9a-f])[0-9a-f]{24,}")

#: A candidate: a run of at least LEAST of these characters, with a digit and a letter.
BODY = np.zeros(256, bool)
BODY[np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-.", np.uint8)] = True
LEAST = 16
DIGIT = np.zeros(256, bool)
DIGIT[0x30:0x3A] = True
LETTER = np.zeros(256, bool)
LETTER[0x41:0x5B] = LETTER[0x61:0x7B] = True

#: Symbols of the models: the body's characters, 0 for any other and for the place before the first.
SYMBOL = np.zeros(256, np.int64)
SYMBOL[BODY] = np.arange(1, BODY.sum() + 1)
SYMBOLS = int(BODY.sum()) + 1
#: Weight of the shorter context in an estimate, and the mean ratio (nats a character) from which a string is random.
BACKOFF, THRESHOLD = 2.0, 0.25

#: Ordinary identifiers, as labelled by hand.
IDENTIFIERS = """
user_account_id_2 get_user_by_id_v2 http_response_code_404 created_at_timestamp_2024 max_retry_count_10 order_line_item_3
is_valid_utf8_string parse_iso8601_date base64_encode_string sha256_hash_function x86_64-linux-gnu-gcc-12 python3.11-site-packages
application/x-www-form-urlencoded1 text/html5-charset=utf-8 node_modules/react-dom-18/index.js src/main/java/com/example/App2.java
usr/local/lib/python3.9/dist-packages org.apache.hadoop.fs.s3a.S3AFileSystem com.fasterxml.jackson.core2 spring-boot-starter-web-2.7
IMG_20240115_142530.jpg screenshot-2023-11-05-at-10.15 report_final_version_3.docx backup-2022-12-31-full.tar.gz data_part_00001.parquet
log4j2-defaults.properties version-1.2.3-SNAPSHOT release-candidate-2024.1 ubuntu-22.04-server-amd64 win32-x64-msvc2019 kernel-5.15.0-91-generic
customer_address_line_1 shipping_address_line_2 phone_number_field_1 table_of_contents_level_3 chapter-12-section-4 figure-3-caption-text
test_case_001_login_page testGetUserById2Returns404 assertEquals100Percent convertUtf8ToUtf16String readUInt32LittleEndian MyClassName2Factory
HttpServletRequest2 java.util.concurrent.ConcurrentHashMap8 System.out.println1 numberOfItemsPerPage10 getElementsByTagName2 addEventListener3
mail6.example.com www.example.com/page/2/index.html example.org/articles/2023/05/17/title-of-post api.example.com/v1/users/12/orders
first.last.92@mail3 john.smith1985 jane_doe_1992 support-team-2024 newsletter-june-2023 invoice-number-10234 customer-order-55871
section_header_bg_color_2 btn-primary-lg-2x col-md-6-offset-3 margin-left-auto-16px font-family-sans-serif-3 background-image-url-2
temperature_sensor_12_reading pressure_valve_3_status motor_speed_rpm_1500 gps_latitude_deg_45 accelerometer_x_axis_2 battery_level_percent_80
select_distinct_top_10 left_outer_join_table2 group_by_month_2024 primary_key_index_1 foreign_key_constraint_2 stored_procedure_v3
matrix_multiply_4x4 fibonacci_sequence_100 quick_sort_algorithm_2 binary_search_tree_3 linear_regression_model_1 k-means-clustering-8
windows-server-2019-datacenter iphone-14-pro-max-256gb samsung-galaxy-s23-ultra macbook-pro-16-inch-2021 playstation-5-console-digital
room_number_204_floor_2 flight-number-ba2490 train_departure_0930 meeting-2024-03-18-notes week_12_lecture_slides semester_2_final_exam
en_US.UTF-8 zh_CN.GB18030 iso-8859-15-latin9 utf-8-unicode-ci-0900 win-1252-western-europe cp437-dos-latin-us koi8-r-cyrillic-russian
ISO-9001-2015-certified RFC-2616-section-14 IEEE-802.11ac-wireless PCI-DSS-v3.2.1 HTTP-1.1-keep-alive TLS-1.3-handshake OAuth-2.0-bearer
covid19-vaccination-centre b2b-marketing-strategy-2024 mp3-audio-file-player h264-video-codec-profile 3d-printing-filament-pla 4k-uhd-television-55inch
""".split()  # fmt: skip

#: Alphabets of the random samples: hexadecimal in both cases, base 32, base 36, base 62, and base 64 of both kinds.
ALPHABETS = (
    b"0123456789abcdef", b"0123456789ABCDEF", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", b"abcdefghijklmnopqrstuvwxyz0123456789",
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
)


def random_strings(each: int = 120, seed: int = 7) -> list[str]:
    """Random samples by a rule: strings of 20 to 64 characters over every alphabet."""
    rng = np.random.default_rng(seed)
    return [
        np.frombuffer(alphabet, np.uint8)[rng.integers(0, len(alphabet), int(rng.integers(20, 65)))].tobytes().decode()
        for alphabet in ALPHABETS for _ in range(each)
    ]


def labelled() -> list[tuple[str, bool]]:
    """The labelled samples that the query trains on: (string, whether it is random)."""
    return [(s, False) for s in IDENTIFIERS] + [(s, True) for s in random_strings()]


@dataclass
class Markov:
    """Log chances of a symbol after the two before it, for random strings less those for identifiers."""

    ratio: np.ndarray

    def scores(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Mean log-likelihood ratio of a character of each string; the strings do not overlap and none is empty."""
        if not starts.size:
            return np.empty(0)
        sizes = ends - starts
        first = np.cumsum(sizes) - sizes
        place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
        x = SYMBOL[data[place + np.repeat(starts, sizes)]]
        before = np.where(place > 0, np.concatenate([[0], x[:-1]]), 0)
        earlier = np.where(place > 1, np.concatenate([[0, 0], x[:-2]])[: x.size], 0)
        return np.add.reduceat(self.ratio[(earlier * SYMBOLS + before) * SYMBOLS + x], first) / sizes


def chances(samples: Iterable[bytes]) -> np.ndarray:
    """Log chances by counts, each context leaning on the shorter one, and that on the evenly likely symbol."""
    counts = np.zeros((SYMBOLS, SYMBOLS, SYMBOLS))
    for sample in samples:
        x = np.concatenate([[0, 0], SYMBOL[np.frombuffer(sample, np.uint8)]])
        np.add.at(counts, (x[:-2], x[1:-1], x[2:]), 1)
    one = counts.sum((0, 1))
    one = (one + 1) / (one.sum() + SYMBOLS)
    two = counts.sum(0)
    two = (two + BACKOFF * one) / (two.sum(1, keepdims=True) + BACKOFF)
    return np.log((counts + BACKOFF * two) / (counts.sum(2, keepdims=True) + BACKOFF)).ravel()


def train(samples: Iterable[tuple[str, bool]] | None = None) -> Markov:
    """Fit both models to labelled strings (all in memory: a labelled table, not a corpus)."""
    samples = labelled() if samples is None else list(samples)
    return Markov(chances(s.encode() for s, random in samples if random) - chances(s.encode() for s, random in samples if not random))


def base_spans(text: bytes) -> dict[str, list[tuple[int, int]]]:
    """Byte ranges of the fixed patterns, kind by kind; what fails its check is dropped and not tried again."""
    return {
        "assign": [m.span() for m in _ASSIGN.finditer(text.lower()) if m.end(1) - m.start(1) >= 6],
        "access": [m.span() for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20],
        "hex": [m.span() for m in _HEX.finditer(text)],
    }


def candidates(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs that may be random strings: long enough, with a digit and a letter; no run crosses a row."""
    starts, ends = common.word_bounds(data, offsets, ~BODY)
    trim = data[ends - 1] == 0x2E if ends.size else np.empty(0, bool)
    ends = ends - trim  # the full stop of a sentence
    keep = ends - starts >= LEAST
    starts, ends = starts[keep], ends[keep]
    if not starts.size:
        return starts, ends
    some = [np.concatenate([[0], np.cumsum(kind[data], dtype=np.int64)]) for kind in (DIGIT, LETTER)]
    keep = (some[0][ends] > some[0][starts]) & (some[1][ends] > some[1][starts])
    return starts[keep], ends[keep]


def untouched(ranges: list[tuple[int, int]], base: list[tuple[int, str, int]]) -> Iterator[tuple[int, str, int]]:
    """The ranges, ascending and apart, that no base span touches."""
    taken, k, reach = sorted((a, b) for a, _, b in base), 0, 0
    for a, b in ranges:
        while k < len(taken) and taken[k][0] < b:
            reach, k = max(reach, taken[k][1]), k + 1
        if reach <= a:
            yield a, RANDOM, b


FOUND = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long"
_ORDER = {kind: k for k, kind in enumerate((*KINDS, RANDOM))}


def _listed(spans: list[tuple[int, str, int]], place: np.ndarray) -> str:
    return ",".join(f"{kind}:{place[a]}:{place[b]}" for a, kind, b in sorted(spans, key=lambda s: (s[0], _ORDER[s[1]])))


def secret_spans(spark: SparkSession, docs: DataFrame, models: Markov | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): counts of the fixed patterns, their digest, and all spans.

    Spans are kind:start:end in code points, end exclusive, by start, then kind. A span that the models add touches none of a
    pattern and has the kind "random". Null and empty texts have none; repeated rows each get a row; other columns are ignored.
    """
    models = models or train()
    held = spark.sparkContext.broadcast(models.ratio)
    nothing = hashlib.sha256(b"").hexdigest()

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Markov(held.value)
        for batch in common.slices(batches, "text", common.ROW_BYTES):
            data, offsets = common.flat(batch.column("text"))
            starts, ends = candidates(data, offsets)
            random = own.scores(data, starts, ends) >= threshold
            starts, ends = starts[random], ends[random]
            row = np.searchsorted(offsets, starts, "right") - 1
            more: dict[int, list[tuple[int, int]]] = {}
            for i, a, b in zip(row.tolist(), starts.tolist(), ends.tolist(), strict=True):
                more.setdefault(i, []).append((a - int(offsets[i]), b - int(offsets[i])))
            raw = data.tobytes()
            out = [(0, 0, 0, nothing, "", 0)] * batch.num_rows
            for i in range(batch.num_rows):
                text = raw[offsets[i] : offsets[i + 1]]
                found = base_spans(text)
                base = [(a, kind, b) for kind in KINDS for a, b in found[kind]]
                added = list(untouched(more.get(i, []), base))
                if not base and not added:
                    continue
                place = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
                digest = hashlib.sha256(_listed(base, place).encode()).hexdigest()
                out[i] = (*(len(found[kind]) for kind in KINDS), digest, _listed(base + added, place), len(added))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), *map(pa.array, zip(*out, strict=True))],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_added"],
            )

    return docs.select("doc_id", "text").mapInArrow(look, FOUND)
