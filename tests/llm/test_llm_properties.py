"""Properties of the operators' cores over generated inputs."""

from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from vellum.llm import media, packing, quality, simhash, urlfilter


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200), st.sets(st.sampled_from([8, 16, 24, 32, 64]), max_size=3))
def test_packing_fills_and_never_overflows(sizes, lengths):
    lengths = tuple(sorted({*lengths, 64}))
    sizes = sorted(sizes, reverse=True)
    bins = defaultdict(list)
    for size, (k, at, length) in zip(sizes, packing.pack(sizes, lengths, 2), strict=True):
        bins[k].append((at, size, length))
    for parts in bins.values():
        end = 0
        for at, size, length in sorted(parts):
            assert at == end and length == parts[0][2]
            end += size
        assert parts[0][2] == min(c for c in lengths if c >= end)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=25), max_size=6), st.integers(2, 5))
def test_repeats_stay_within_their_text(texts, n):
    words = [w for t in texts for w in t]
    mask = quality.repeated_words(np.array([hash(w) for w in words], np.int64).view(np.uint64), np.repeat(np.arange(len(texts)), [len(t) for t in texts]), n)
    want = []
    for t in texts:
        spots = defaultdict(list)
        for i in range(len(t) - n + 1):
            spots[tuple(t[i : i + n])].append(i)
        hit = {j for v in spots.values() if len(v) > 1 for i in v for j in range(i, i + n)}
        want += [j in hit for j in range(len(t))]
    assert mask.tolist() == want


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=2000))
def test_payloads_are_lossless(raw):
    payload = media.pad(raw)
    assert len(payload) % media.WIDTH == 0 and payload and payload.rstrip(b" ") == raw.rstrip(b" ")
    stored = media.encode_png(payload)
    assert media.decode_png(stored) == payload
    assert media.png_header(stored[: media.HEADER_BYTES])["height"] * media.WIDTH == len(payload)


@given(st.text(max_size=60))
def test_urls_without_a_scheme_are_empty(text):
    raw = text.replace("://", "").encode()
    assert urlfilter.split_url(raw) == (b"", b"")
    host, path = urlfilter.split_url(b"a://" + raw)
    assert not set(host) & set(b"/?#") and not set(path) & set(b"?#") and (not path or path[:1] == b"/")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["Aa", "b", "c\td", "É", "  "]), max_size=12), st.integers(1, 4))
def test_shingles(words, width):
    import xxhash

    text = " ".join(words)
    ws = "".join(c.lower() if c.isascii() else c for c in text).encode().split()
    runs = [b" ".join(ws[i : i + width]) for i in range(max(1, len(ws) - width + 1))] if ws else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    assert simhash.shingle_hashes(text.encode(), width).tolist() == hashes
    assert simhash.majority(np.array(hashes, np.uint64)) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
