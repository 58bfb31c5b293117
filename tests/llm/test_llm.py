"""The operators of the llm subpackage against brute force, round trips and held-out accuracy."""

import base64
import hashlib
import json
import math
import re
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest

from clauseframe.llm import bpe, chat, fingerprint, neardup, packing, quality, secrets, substrings, tokencount, tokens, topk
from clauseframe.llm.common import Words, from_gaps, gaps, windows
from clauseframe.llm.components import components
from clauseframe.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], DOCS)


AWKWARD = [(None, None), (None, "some text without an id"), (1, ""), (2, " \n\t"), (3, "a  b\n\n c"), (4, None), (5, "é　x 😀 " * 3), (5, "é　x 😀 " * 3), (6, "word " * 3000)]


@pytest.fixture(scope="module")
def corpus(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


# ---- secrets -------------------------------------------------------------------------------------------------------


def test_base_spans_equal_the_plain_patterns(spark, sf, corpus):
    assign = re.compile(r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    got = {r.doc_id: r for r in QUERIES["op1_secret_scan"](spark, sf).collect()}
    assert len(got) == len(corpus)
    for doc_id, text in corpus:
        base = [("assign", *m.span()) for m in assign.finditer(text) if len(m[2]) >= 6]
        base += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        base += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        base.sort(key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))
        counts = Counter(s[0] for s in base)
        assert (got[doc_id].n_assign, got[doc_id].n_access, got[doc_id].n_hex) == (counts["assign"], counts["access"], counts["hex"])
        assert got[doc_id].base_sha256 == sha(",".join(f"{k}:{s}:{e}" for k, s, e in base))


def der(tag, body):
    size = bytes([len(body)]) if len(body) < 128 else b"\x82" + len(body).to_bytes(2, "big")
    return bytes([tag]) + size + body


def test_encoded_candidates_need_their_structure():
    key = der(0x30, der(2, b"\0") + b"".join(der(2, bytes([i]) * 30) for i in range(8)))
    text = base64.b64encode(key).decode()
    assert ("b64_key", 4, 4 + len(text)) in secrets.find(f"key {text} end")
    assert ("hex_key", 0, 2 * len(key)) in secrets.find(key.hex())
    broken = base64.b64encode(key[:-1] + b"\0\0").decode()
    assert not [s for s in secrets.find(broken) if s[0] == "b64_key"]
    assert not [s for s in secrets.find("A" * 80) if s[0] == "b64_key"]
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    token = f"{part({'alg': 'HS256'})}.{part({'sub': 'x'})}.c2lnbmF0dXJl"
    assert ("jwt", 0, len(token)) in secrets.find(token)
    assert not [s for s in secrets.find(f"{part({'typ': 'x' * 9})}.{part({'sub': 'x'})}.c2lnbmF0dXJl") if s[0] == "jwt"]
    pem = f"-----BEGIN PRIVATE KEY-----\n{text}\n-----END PRIVATE KEY-----"
    assert ("pem", 0, len(pem)) in secrets.find(pem)
    field = lambda b: len(b).to_bytes(4, "big") + b
    ssh = b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4, "big") + field(b"p" * 20) + field(b"k" * 40)
    assert secrets.is_openssh_key(ssh) and not secrets.is_openssh_key(ssh + b"x") and not secrets.is_openssh_key(ssh[:-1])


def private_keys():
    """One key of each form, as DER."""
    numbers = lambda n: b"".join(der(2, bytes([i + 1]) * 30) for i in range(n))
    rsa, dsa = der(0x30, der(2, b"\0") + numbers(8)), der(0x30, der(2, b"\0") + numbers(5))
    sec1 = der(0x30, der(2, b"\1") + der(4, b"k" * 32))
    algorithm = der(0x30, der(6, b"\x2a\x86\x48") + der(5, b""))
    return {"rsa": rsa, "dsa": dsa, "sec1": sec1, "pkcs8": der(0x30, der(2, b"\0") + algorithm + der(4, rsa)), "encrypted": der(0x30, algorithm + der(4, b"\x9c" * 48))}


def test_key_forms_and_near_misses():
    keys = private_keys()
    spans = lambda t, kind: [t[s:e] for k, s, e in secrets.find(t) if k == kind]
    armour = lambda label, body, sep="\n": f"-----BEGIN {label}-----{sep}{body}{sep}-----END {label}-----"
    for name, data in keys.items():
        body, label = base64.b64encode(data).decode(), "ENCRYPTED PRIVATE KEY" if name == "encrypted" else "PRIVATE KEY"
        folded = "\n".join(body[i : i + 64] for i in range(0, len(body), 64))
        assert spans(f"x {armour(label, folded)} y", "pem") == [armour(label, folded)]
        assert spans(f'"{armour(label, folded, chr(92) + "n")}"', "pem") == [armour(label, folded, chr(92) + "n")]
        assert not spans(armour(label, base64.b64encode(data[:-3]).decode()), "pem")
        assert not spans(armour(label, body).replace("-----END", "-----ENDING"), "pem")
        if name != "encrypted":
            assert spans(f"key={body};", "b64_key") == [body]
            url = body.translate(str.maketrans("+/", "-_"))
            assert spans(f"({url})", "b64_key") == [url] and spans(f"at\n{folded}\nend", "b64_key") == [folded]
            assert not spans(base64.b64encode(data + b"\0").decode(), "b64_key")
    assert not secrets.is_der_key(der(0x30, der(2, b"\0") + der(0x30, der(6, b"\x2a")) + der(4, b"\x30\x82\x01")))  # octets hold no whole item
    whole = base64.b64encode(armour("RSA PRIVATE KEY", base64.b64encode(keys["rsa"]).decode()).encode()).decode()
    assert spans(f"client-key-data: {whole}", "b64_key") == [whole]
    legacy = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0123456789ABCDEF0123456789ABCDEF\n\n" + base64.b64encode(b"c" * 64).decode()
    assert spans(armour("RSA PRIVATE KEY", legacy), "pem") == [armour("RSA PRIVATE KEY", legacy)]
    assert not spans(armour("RSA PRIVATE KEY", legacy.replace("DEK-Info", "Other")), "pem")


def test_tokens_in_dotted_runs():
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    token = f"{part({'alg': 'HS256'})}.{part({'sub': 'x'})}.c2lnbmF0dXJl"
    for front, back in (("service1.", ""), ("https://host.internalnet.", "."), ("", "." + token), ("a.b.", ".x.y")):
        found = [(front + token + back)[s:e] for k, s, e in secrets.find(front + token + back) if k == "jwt"]
        assert found == [token] * (front + token + back).count(token)
    assert not [1 for k, *_ in secrets.find(token.replace("c2lnbmF0dXJl", "c2ln")) if k == "jwt"]


@pytest.mark.parametrize("unit", ["a", "A", "-", "aB3_", "eyJhbGciOi.", "eyJ.", "-----BEGIN PRIVATE KEY-----", "ab/+\n", "token ", "AKIA", "secret=", "A" * 64 + "\n"])
def test_secret_scan_is_linear(unit):
    for text in (unit * (5_000_000 // len(unit)), unit * (2_500_000 // len(unit)) + "!" + "é" * 100):
        begun = time.process_time()
        secrets.find(text)
        assert time.process_time() - begun < 8  # a quadratic search would take hours


def test_secret_scan_of_awkward_rows(spark):
    rows = secrets.secret_digest(docs_of(spark, [*AWKWARD, (7, "ſecret: abcdefgh token=abc PASSWORD = 'hunter22'")])).collect()
    assert len(rows) == len(AWKWARD) + 1
    got = {r.doc_id: r for r in rows}
    assert got[4].spans == "" and got[4].base_sha256 == sha("")
    assert got[7].n_assign == 1 and got[7].spans.startswith("assign:27:")
    clashing = docs_of(spark, [(1, "x")]).selectExpr("*", "1 AS spans")
    assert secrets.scan_secrets(clashing).columns == [*docs_of(spark, [(1, "")]).columns, "spans"]
    assert secrets.redact_secrets(docs_of(spark, [(1, "a token=abcdef z"), (2, None)])).orderBy("doc_id").select("text").collect() == [("a [SECRET] z",), (None,)]
    assert secrets.scan_secrets(docs_of(spark, [(1, "x")]).limit(0)).count() == 0


# ---- fingerprints --------------------------------------------------------------------------------------------------


def test_fingerprints_follow_the_edited_neighbours(spark, sf, corpus):
    got = {r.doc_id: r for r in QUERIES["op2_order_minhash"](spark, sf).collect()}
    ordered = sorted(corpus, reverse=True)
    assert len(got) == len(corpus)
    for (doc_id, text), (_, following) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        r = got[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), sha(edited))
        own, changed, other = map(fingerprint.order_minhash, (text, edited, following))
        assert (r.fingerprint, r.edited_fingerprint) == (fingerprint.shown(own), fingerprint.shown(changed))
        assert (r.near_edited, r.near_next) == (np.mean(own == changed), np.mean(own == other))
    assert np.mean([r.near_edited for r in got.values()]) > 0.15 > np.mean([r.near_next for r in got.values()])


def test_order_minhash_against_a_plain_selection():
    text = "the cat sat on the mat, the cat sat on the hat; " * 3 + "end"
    h = fingerprint.windows(np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1), fingerprint.K)
    seen, numbered = Counter(), []
    for x in h.tolist():
        numbered.append((x + seen[x] * 0xC2B2AE3D27D4EB4F) % 2**64)
        seen[x] += 1
    numbered = fingerprint.mixed(np.array(numbered, np.uint64))
    low = numbered.astype(np.uint32)
    for i in range(fingerprint.SIZE):
        ranked = sorted(range(len(low)), key=lambda j: (int(low[j] ^ fingerprint.XOR[i]) * int(fingerprint.MULTIPLY[i]) % 2**32, j))[: fingerprint.TUPLE]
        value = np.zeros(1, np.uint64)
        for j in sorted(ranked):
            value = fingerprint.mixed(value * np.uint64(3) + numbered[j : j + 1])
        assert fingerprint.order_minhash(text)[i] == (int(value[0]) >> 32) | 1


def test_order_matters_to_the_fingerprint():
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefghij"), 9)) for _ in range(120)]
    same, turned = " ".join(words), " ".join(words[60:] + words[:60])
    assert fingerprint.likeness(fingerprint.order_minhash(same), fingerprint.order_minhash(turned)) < 0.9
    assert (fingerprint.order_minhash("") == 0).all() and (fingerprint.order_minhash("a") != fingerprint.order_minhash("b")).any()


def test_fingerprints_of_awkward_rows(spark):
    rows = fingerprint.neighbour_digest(docs_of(spark, AWKWARD)).collect()
    assert len(rows) == len(AWKWARD) and all(len(r.fingerprint) == 8 * fingerprint.SIZE for r in rows)
    alone = fingerprint.neighbour_digest(docs_of(spark, [(1, "abcdef")])).collect()[0]
    assert alone.edited_sha256 == sha("abcdab") and alone.near_next == 1.0
    assert fingerprint.neighbour_digest(docs_of(spark, [(1, "")]).limit(0)).count() == 0
    assert fingerprint.fingerprints(docs_of(spark, AWKWARD)).count() == len(AWKWARD)


# ---- BPE -----------------------------------------------------------------------------------------------------------


def test_bpe_equals_the_tokenizer(spark, sf, corpus):
    t = tokens.load(bpe.VOCABULARY)
    got = {r.doc_id: r for r in QUERIES["op3_bpe_distinct_words"](spark, sf).collect()}
    for doc_id, text in corpus:
        ids = t.encode(text, add_special_tokens=False).ids
        assert got[doc_id][1:] == (len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False)))


def test_bpe_of_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", 40)
    texts = [*AWKWARD, (7, "a  b\n\n c<|endoftext|>  d"), (8, "  x   y "), (9, "it's  'll\t\tx"), (10, "\n" * 50 + "z"), (11, "foo \n<|endoftext|>\n\n"), (12, "\x1c\x1d a\x85\x85b"), (13, "x" * 3000)]
    t = tokens.load(bpe.VOCABULARY)
    encoded = bpe.encode(docs_of(spark, texts))
    expected = sorted((i or -1, t.encode(x or "", add_special_tokens=False).ids) for i, x in texts)
    assert sorted((r.doc_id or -1, r.ids) for r in encoded.collect()) == expected
    back = bpe.decode(encoded).collect()
    assert sorted((r.doc_id or -1, r.decoded) for r in back) == sorted((i or -1, x or "") for i, x in texts)
    assert bpe.encode(docs_of(spark, [(1, "")]).limit(0)).count() == 0


def test_packed_numbers_and_words_come_back():
    for n in ([], [0], [1, 2, 2**32 - 1, 70000]):
        assert bpe.unpacked(bpe.packed(np.array(n, np.uint32))).tolist() == n
    words = [" a", "é\x00", "", "\n\nb"]
    assert bpe.unpacked_words(bpe.packed_words(words)) == words


# ---- near duplicates -----------------------------------------------------------------------------------------------


def shingle_set(text):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(text or "")]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def groups(texts):
    sets = [(i, shingle_set(t)) for i, t in texts if i is not None]
    up = {i: i for i, _ in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, (i, x) in enumerate(sets):
        for j, y in sets[a + 1 :]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                up[max(root(i), root(j))] = min(root(i), root(j))
    return {i: root(i) for i in up}


def test_near_duplicates_equal_all_pairs(spark, sf, corpus):
    got = {r.doc_id: r for r in QUERIES["op4_minmax_neardup"](spark, sf).collect()}
    assert {i: r.component_id for i, r in got.items()} == groups(corpus)
    assert all(got[i].n_shingles == len(shingle_set(t)) and got[i].kept == (got[i].component_id == i) for i, t in corpus)


@pytest.mark.parametrize("block", [3_000_000, 300])
def test_near_duplicates_of_a_large_group(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK_WORDS", block)
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(100)]
    texts = [(100, " ".join(base[:85] + [f"q{i}" for i in range(15)]))]
    for i in range(40):
        w = list(base)
        for at in rng.integers(0, 100, 3 if i % 4 else 9):
            w[at] = f"x{i}_{at}"
        texts += [(i, " ".join(w)), (1000 + i, " ".join(w))]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs_of(spark, texts)).collect()}
    assert got == groups(texts)


def test_near_duplicates_of_awkward_rows(spark):
    rows = neardup.near_duplicates(docs_of(spark, [*AWKWARD, (9, "One two three"), (8, "one TWO three"), (7, "É two")])).collect()
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
    assert sorted(got[None]) == [(0, None, True), (1, None, True)]
    assert got[1] == [(0, 1, True)] and got[2] == [(0, 2, True)] and got[4] == [(0, 4, True)]
    assert got[5] == [(2, 5, True)] * 2
    assert got[9] == [(1, 8, False)] and got[8] == [(1, 8, True)] and got[6][0][0] == 1
    assert neardup.near_duplicates(docs_of(spark, [(1, "")]).limit(0)).count() == 0
    kept = neardup.keep_one(docs_of(spark, [(1, "a b c d e f"), (2, "a b c d e f"), (3, None), (None, "a b c d e f")]).selectExpr("*", "1 AS kept"))
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 3] and "kept" in kept.columns


def test_small_sets_always_meet(spark):
    """Links of sets with at most eight shingles have a key of their own."""
    rng = np.random.default_rng(7)
    for n in range(1, neardup.SMALL + 1):
        own = rng.integers(0, 2**63, n).astype(np.uint64)
        for gone in range(n + 1):
            for more in range(neardup.SMALL - (n - gone) + 1):
                other = np.unique(np.append(own[gone:], rng.integers(0, 2**63, more).astype(np.uint64)))
                if len(other) and 100 * (n - gone) >= 75 * (n + more) and len(other) <= neardup.SMALL:
                    assert set(neardup.subset_keys(own)) & set(neardup.subset_keys(other))


@pytest.mark.parametrize("block", [4096, 7])
def test_a_shared_passage_makes_no_cluster(spark, monkeypatch, block):
    """Documents of similarity 0.4 to each other, with real copies among them: candidates are the copies, and no link is lost."""
    monkeypatch.setattr(neardup, "BUCKET_BLOCK", block)
    passage = " ".join(f"p{i}" for i in range(124))
    texts = [(i, f"{passage} " + " ".join(f"d{i}_{j}" for j in range(92))) for i in range(120)]
    texts += [(1000 + i, t.replace(f"d{i}_5 ", "new ")) for i, t in texts[::10]]
    seen = []
    plain = neardup.exact_links
    monkeypatch.setattr(neardup, "exact_links", lambda members: seen.append([r.cluster for r in members.select("cluster").collect()]) or plain(members))
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs_of(spark, texts)).collect()}
    assert got == groups(texts)
    assert max(Counter(seen[0]).values()) <= 6


def test_components_of_paths_and_loops(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (300, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 200, 300: 200}


# ---- token counts --------------------------------------------------------------------------------------------------


def test_token_counts_equal_the_tokenizer(spark, sf, corpus):
    t = tokens.load(tokencount.VOCABULARY)
    t.encode_special_tokens = True
    got = {r.doc_id: r.n_tokens for r in QUERIES["op5_token_counts"](spark, sf).collect()}
    assert got == {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in corpus}


def test_separator_scan_across_blocks(spark, tmp_path):
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 7, 1001).astype("<u2")
    ids[100:160] = 3
    (tmp_path / "a").write_bytes(ids.tobytes() + b"x")
    (tmp_path / "b").write_bytes(np.zeros(1, "<u2").tobytes())
    files = spark.createDataFrame([("a", 2003), ("b", 2), ("c", 0)], "file string, bytes long")
    ends = np.flatnonzero(ids == 0)
    starts = np.append(0, ends + 1)
    expected = [("a", i + 1, int(s), int(e - s)) for i, (s, e) in enumerate(zip(starts, np.append(ends, 1001), strict=True)) if i < len(ends) or s < e] + [("b", 1, 0, 0)]
    for size in (2, 32, 4096):
        got = tokencount.count_tokens(spark, str(tmp_path), files, 0, 2, size).orderBy("file", "doc").collect()
        assert [tuple(r) for r in got] == expected
    assert tokencount.count_tokens(spark, str(tmp_path), files.limit(0), 0, 2).count() == 0


def test_token_counts_of_awkward_rows(spark):
    rows = tokencount.token_counts(docs_of(spark, [*AWKWARD, (7, "a<|endoftext|>b")])).collect()
    assert len(rows) == len(AWKWARD) + 1 and {r.doc_id: r.n_tokens for r in rows}[4] == 0


# ---- substrings ----------------------------------------------------------------------------------------------------


def without_repeats(texts, n=13):
    least, windows = {}, {}
    for i, t in texts:
        w = WORD.findall(t or "")
        for k in range(len(w) - n + 1 if i is not None else 0):
            x = tuple(w[k : k + n])
            least[x] = min(i, least.get(x, i))
    out = []
    for i, t in texts:
        w = WORD.findall(t or "")
        gone = {k + d for k in range(len(w) - n + 1) if i is not None and least[tuple(w[k : k + n])] < i for d in range(n)}
        windows[i] = gone
        out.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return sorted(out, key=str)


def test_substrings_equal_brute_force(spark, sf, corpus):
    got = QUERIES["op6_substring_dedup"](spark, sf).collect()
    assert sorted((tuple(r) for r in got), key=str) == without_repeats(corpus)


@pytest.mark.parametrize(("load", "block"), [(4, 10_000), (0.02, 50_000), (4, 1)])
def test_substrings_in_small_blocks_and_with_an_overloaded_sketch(spark, corpus, monkeypatch, load, block):
    monkeypatch.setattr(substrings, "LOAD", load)
    monkeypatch.setattr(substrings, "BLOCK_BYTES", block)
    monkeypatch.setattr(substrings, "RANGE_BITS", 9)
    monkeypatch.setattr(substrings, "GROUP_WINDOWS", 5000)
    texts = [*corpus[:80], *((i, t) for i, t in AWKWARD if i not in dict(corpus[:80])), (500, corpus[0][1]), (501, " ".join("abcdefghijklmnop") * 2)]
    got = substrings.substring_digest(docs_of(spark, texts)).collect()
    assert sorted((tuple(r) for r in got), key=str) == without_repeats(texts)


def test_substrings_of_awkward_rows(spark):
    texts = [*AWKWARD, (7, None), (6, "word " * 3000)]
    got = substrings.substring_digest(docs_of(spark, texts)).collect()
    assert sorted((tuple(r) for r in got), key=str) == without_repeats(texts)
    assert substrings.remove_repeats(docs_of(spark, [(1, "")]).limit(0)).count() == 0
    kept = substrings.remove_repeats(docs_of(spark, [(1, "a \n b"), (2, None)]).selectExpr("*", "5 AS n_words")).orderBy("doc_id").collect()
    assert [(r.text, r.n_words, r.n_removed) for r in kept] == [("a \n b", 2, 0), (None, 0, 0)]


def test_gaps_in_bytes_come_back():
    for n in ([], [0], [0, 0, 3, 127, 128, 511, 10_000, 10_000 + 2**14, 2**40]):
        assert from_gaps(gaps(np.array(n, np.int64))).tolist() == n


def test_word_hashes_tell_words_apart():
    text = "a b  ab\tba\n a é e´ \x0b\x0c x" + " z" * 300
    w = text.encode().split()
    for words in (Words(), Words(most=2)):
        a, b = words.halves(w)
        assert len(set(a.tolist())) == len(set(b.tolist())) == len(set(w)) and a[0] == a[4]
        assert words.halves([]).shape == (2, 0) and words.halves([b"a"])[0, 0] == a[0]
    # one letter by bit parity of the place, and its swapped twin: equal under any polynomial modulo a power of two
    twins = ["".join("ab"[bin(i).count("1") % 2 ^ turn] for i in range(1024)) for turn in (0, 1)]
    a, b = Words().halves([t.encode() for t in twins])
    assert a[0] != a[1] and b[0] != b[1]


def test_runs_have_hashes_of_their_own():
    rng = np.random.default_rng(8)
    h = rng.integers(0, 2**63, 2).astype(np.uint64)
    for n in (1, 2, 3, 5, 8, 13):
        runs = windows(h[rng.integers(0, 2, 4000 + n - 1)] if n > 1 else h, n)
        plain = {}
        bits = np.random.default_rng(9).integers(0, 2, 4000 + n - 1) if n > 1 else np.arange(2)
        for i, value in enumerate(windows(h[bits], n).tolist()):
            plain.setdefault(tuple(bits[i : i + n].tolist()), set()).add(value)
        assert all(len(v) == 1 for v in plain.values()) and len({v for own in plain.values() for v in own}) == len(plain)
        assert len(runs) == (4000 if n > 1 else 2)
    # runs of two words that swap by bit parity
    parity = np.array([bin(i).count("1") % 2 for i in range(13)])
    assert windows(h[parity], 13)[0] != windows(h[1 - parity], 13)[0]


def test_colliding_words_are_no_repeats(spark):
    twins = ["".join("ab"[bin(i).count("1") % 2 ^ turn] for i in range(1024)) for turn in (0, 1)]
    texts = [(turn, " ".join([twins[turn], *"cdefghijklmn"])) for turn in (0, 1)]
    assert [r.n_removed for r in substrings.remove_repeats(docs_of(spark, texts)).collect()] == [0, 0]
    texts = [(turn, " ".join([twins[turn]] * 3 + [str(turn)])) for turn in (0, 1)]
    assert all(r.kept for r in neardup.near_duplicates(docs_of(spark, texts)).collect())


def test_the_sketch_passes_a_like_share_at_every_size(spark):
    """Windows that stand in one document only pass both rows for about one in twenty, whatever the size."""
    rng = np.random.default_rng(6)
    for n in (300, 3000):
        texts = [(i, " ".join(map(str, rng.integers(0, 10**9, 120)))) for i in range(n)]
        bits = max(10, (substrings.LOAD * (sum(len(t) for _, t in texts) // 5)).bit_length())
        rows = docs_of(spark, texts).repartition(4).select("doc_id", "text")
        table = substrings.bucketed(substrings.with_block(rows, "block"), "block", "test")
        answers = substrings.sketch_answers(table, 13, bits).toPandas()
        passed = total = 0
        for block, own in table.toPandas().groupby("block"):
            made = substrings.Block(substrings.pa.Table.from_pandas(own[["doc_id", "text"]], preserve_index=False), 13)
            passed += substrings.maybe_repeated(made, substrings.pa.Table.from_pandas(answers[answers.block == block], preserve_index=False), bits).sum()
            total += len(made.a)
        assert total == n * 108 and passed / total < 0.06


# ---- quality -------------------------------------------------------------------------------------------------------


def test_quality_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = QUERIES["op7_quality_classifier"](spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([p == y for p, y in held]) >= 0.95 and all(p for p, y in held if y)


def plain_model(rows, bits, how):
    """Follow the regularised leader, one feature at a time, over (label, features) in order; the weight of any feature."""
    z, n = {}, {}

    def weight(i):
        zi = z.get(i, 0.0)
        if abs(zi) <= how.l1:
            return 0.0
        return -(zi - math.copysign(how.l1, zi)) / ((how.beta + math.sqrt(n.get(i, 0.0))) / how.alpha + how.l2)

    for _ in range(how.epochs):
        for label, x in rows:
            w = {i: weight(i) for i in x}
            error = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items()))) - label
            for i, v in x.items():
                g = error * v
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / how.alpha * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return weight


def plain_features(text):
    """Hash -> log(1 + count), scaled to length one, of words and pairs with repeats marked; and the constant."""
    hashes, counts, words = quality.WordHashes(), Counter(), re.findall(r"\w+|[^\w\s]+", text)
    h = [int(quality.REPEAT) if i and words[i] in words[max(0, i - 2) : i] else hashes[w] for i, w in enumerate(words)]
    one = lambda x: int(x[0]) % (2**quality.BITS - 1) + 1
    for x in h:
        counts[one(quality.mixed(np.array([x], np.uint64)))] += 1
    for a, b in zip(h, h[1:], strict=False):
        counts[one(quality.windows(np.array([a, b], np.uint64), 2))] += 1
    norm = math.sqrt(sum(math.log1p(c) ** 2 for c in counts.values()))
    return {i: math.log1p(c) / norm for i, c in counts.items()} | {0: 1.0}


def test_scores_equal_a_plain_model(spark, sf, corpus):
    labels = {}
    for r in spark.read.parquet(f"{sf}/labels.parquet").collect():
        if r.quality is not None and zlib.crc32(str(r.doc_id).encode()) % 5:
            labels[r.doc_id] = min(r.quality, labels.get(r.doc_id, 1))
    texts = dict(corpus)
    learned = [i for i in labels if i in texts]
    order = [r.doc_id for r in docs_of(spark, [(i, "") for i in learned]).selectExpr("doc_id", "xxhash64(doc_id) AS at").orderBy("at", "doc_id").collect()]
    weight = plain_model([(labels[i], plain_features(texts[i])) for i in order], quality.BITS, quality.Ftrl())
    got = {r.doc_id: r.score for r in QUERIES["op7_quality_classifier"](spark, sf).collect()}
    for doc_id, text in corpus:
        dot = sum(weight(i) * v for i, v in plain_features(text).items())
        assert abs(got[doc_id] - 1 / (1 + math.exp(-dot))) < 1e-4


def test_repeated_rows_of_a_label_are_learned_once(spark):
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")
    once = quality.fit(docs_of(spark, [(1, "b good text"), (3, "bad ! ! !")]), labels)
    many = quality.fit(docs_of(spark, [(1, "b good text")] * 9 + [(1, "c later text"), (3, "bad ! ! !")]), labels)
    assert (once == many).all() and once.any()


def test_ftrl_separates_and_is_sparse():
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(300):
        y = int(rng.random() < 0.5)
        i = np.array([0, 1 + y, *rng.integers(100, 200, 5)], np.int32)
        rows.append((y, *np.unique(i, return_counts=True)))
    w = quality.train([(y, i, x.astype(np.float32)) for y, i, x in rows], quality.Ftrl())
    assert w[2] > 0.5 > -0.5 > w[1] and np.count_nonzero(w) < 210


def test_quality_of_awkward_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (3, 1, 0), (5, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.quality_scores(docs_of(spark, AWKWARD), labels).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality.quality_scores(docs_of(spark, AWKWARD), labels.limit(0)).collect()} == {0.5}
    assert quality.quality_scores(docs_of(spark, AWKWARD).limit(0), labels).count() == 0


# ---- top-k ---------------------------------------------------------------------------------------------------------


def plain_topk(vectors, k, every, scale=1024):
    ok = {i: [int(np.floor(scale * float(c))) for c in v] for i, v in vectors if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)}
    out = []
    for q in ok:
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(ok[q], ok[x], strict=True)), x) for x in ok if x != q and len(ok[x]) == len(ok[q]))[:k]
            out += [(q, r + 1, x, -s) for r, (s, x) in enumerate(scored)]
    return sorted(out)


def test_topk_equals_all_products(spark, sf):
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in QUERIES["op8_exact_topk"](spark, sf).collect()) == plain_topk(vectors, 10, 100)


def test_topk_of_awkward_rows(spark):
    rng = np.random.default_rng(2)
    vectors = [(i, [float(c) for c in rng.normal(size=8)]) for i in range(60)]
    vectors += [(100 + i, vectors[0][1]) for i in range(20)]  # ties
    vectors += [(200, None), (300, [None] * 8), (400, [float("nan")] * 8), (500, [float("inf")] * 8), (600, [1.0] * 3), (700, [2.0] * 3), (None, [1.0] * 8), (800, []), (900, [1e9] * 8)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in topk.embedding_topk(df, 4, 10).collect())
    assert got == plain_topk([(i, v and [None if c is None else float(np.float32(c)) for c in v]) for i, v in vectors], 4, 10)
    small = topk.whole(df, 1024.0)
    blocks = topk.search(small, small.where("vec_id % 10 = 0"), 4, query_block=3, block=7)
    assert sorted(tuple(r) for r in blocks.collect()) == got
    assert topk.embedding_topk(df.limit(0)).count() == 0


def test_topk_of_a_full_pair_of_blocks_holds_little():
    """4,096 queries against 16,384 rows, as one task would have them."""
    rng = np.random.default_rng(10)
    q, x = rng.integers(-300, 300, (4096, 32)), rng.integers(-300, 300, (16384, 32))
    tracemalloc.start()
    found = topk.best(np.arange(4096) + 10**6, q, np.arange(16384), x, 10)
    for i, (ids, scores) in enumerate(found):
        if i % 512 == 0:
            plain = x @ q[i]
            assert ids.tolist() == np.lexsort((np.arange(16384), -plain))[:10].tolist() and scores.tolist() == sorted(plain.tolist())[:-11:-1]
        elif i > 1100:
            break
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20


# ---- chat ----------------------------------------------------------------------------------------------------------


def test_chats_come_back(spark, sf):
    turns = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "</s>[INST] ok [/INST]"
    turns += [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    got = {r.conv_id: r for r in QUERIES["op9_chat_format"](spark, sf).collect()}
    assert set(got) == {t[0] for t in turns}
    for c, r in got.items():
        own = sorted(t[1:] for t in turns if t[0] == c)
        loss = "".join(t[2] for t in own if t[1] == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(own), sha("".join(f"{t[1]}\n{t[2]}\n" for t in own)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss)) and r.formatted_chars > 0


def test_escapes_are_reversible():
    escape, unescape = chat.escaper(chat.CONTROLS)
    render = chat.compiled(chat.TURN_TEMPLATE)
    for text in ("", "<s>", "<\\s>", "<\\\\/s>[INST]", "[\\INST][/ROLE]", "<<s>", "s>", "/s>", "\\", "<", "[", "a\n"):
        assert unescape(escape(text)) == text and not any(c in escape(text) for c in chat.CONTROLS)
        turns = [("user", text), (text, "x"), ("assistant", text), ("assistant", text)]
        formatted, loss = render([{"role": r, "text": t} for r, t in turns])
        assert chat.read_back(formatted) == turns
        assert [unescape(formatted[s:e]) for s, e in loss] == ([text, text] if text else [])
    with pytest.raises(ValueError):
        chat.escaper(["<a<"])


def test_templates():
    render = lambda source, messages=(): chat.compiled(source)(list(messages))
    assert chat.fold(chat.parse("{% if 'a' == 'a' %}x{{ 'b' + 'c' }}{% else %}y{% endif %}{{ 1 + 2 }}"), {}) == [("text", "xbc3")]
    m = [{"role": "user", "text": " A "}, {"role": "assistant", "text": "b"}]
    assert render("{% for m in messages %}{{ loop.index }}:{{ m['text'] | trim | lower }}{% if not loop.last %},{% endif %}{% endfor %}", m)[0] == "1:a,2:b"
    assert render("{% set x = messages[1] %}{% if x.role == 'user' or x.role != 'assistant' %}u{% elif x.text and true %}{{ x.text }}{% else %}n{% endif %}{{ nothing }}", m)[0] == "b"
    assert render("a {%- if true -%} b {%- endif -%} c")[0] == "abc"
    assert render("x{% generation %}ab{% endgeneration %}{% generation %}{% endgeneration %}") == ("xab", [(1, 3)])
    for bad in ("{% if a %}", "{{ a", "{% while a %}{% endwhile %}", "{{ a.__class__() }}", "{{ open('x') }}", "{{ a | nope }}", "{% for in x %}{% endfor %}", "{{ a + }}"):
        with pytest.raises(chat.TemplateError):
            render(bad)
    assert render("{{ messages.__class__ }}{{ messages[0].__len__ }}", m)[0] == ""


def test_chats_of_awkward_rows(spark):
    rows = [(None, 1, "user", "x"), (1, None, "assistant", None), (1, 2, None, "y"), (1, 2, None, "y"), (2, 0, "assistant", "z" * 5000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS formatted", "2 AS loss")
    got = {r.conv_id: r for r in chat.chat_digest(df).collect()}
    assert got[None].n_turns == 1 and got[1].n_turns == 3 and got[1].loss_chars == 0 and got[2].loss_chars == 5000
    assert chat.chat_digest(df.limit(0)).count() == 0


# ---- packing -------------------------------------------------------------------------------------------------------


def test_packing_keeps_every_token(spark, sf, corpus):
    t = tokens.load(packing.VOCABULARY)
    rows = QUERIES["op10_best_two_fit"](spark, sf).collect()
    pieces = {(r.doc_id, r.piece): r for r in rows}
    assert len(pieces) == len(rows)
    for doc_id, text in corpus:
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        for i, s in enumerate(range(0, len(ids), 2048)):
            own, r = ids[s : s + 2048], pieces.pop((doc_id, i))
            assert (r.start, r.length, r.ids_crc32) == (s, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
    assert not pieces
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 2048
    assert len(sequences) <= -(-sum(r.length for r in rows) // 2048) + 2


def test_best_two_fit_swaps_in_two():
    # greedy takes 6, then 3, and fills 9 of 10; 3 gives way to 2 and 2, which fill it
    assert sorted(map(sorted, packing.best_two_fit([6, 3, 2, 2], 10))) == [[0, 2, 3], [1]]
    assert sorted(map(sorted, packing.best_two_fit([6, 3, 1, 1], 10))) == [[0, 1, 2], [3]]
    rng = np.random.default_rng(4)
    for _ in range(30):
        lengths = rng.integers(1, 101, rng.integers(1, 200)).tolist()
        bins = packing.best_two_fit(lengths, 100)
        assert sorted(i for b in bins for i in b) == list(range(len(lengths))) and all(sum(lengths[i] for i in b) <= 100 for b in bins)
        assert len(bins) <= 1.15 * -(-sum(lengths) // 100) + 2
    assert packing.best_two_fit([], 10) == []


def test_packing_of_awkward_rows(spark):
    docs = docs_of(spark, [*AWKWARD, (7, "<|ENDOFTEXT|> <|endoftext|>")])
    rows = packing.pack_digest(docs).collect()
    assert sum(r.length for r in rows if r.doc_id == 4) == 1 and len([r for r in rows if r.doc_id == 5]) == 2
    t = tokens.load(packing.VOCABULARY)
    assert sum(r.length for r in rows if r.doc_id == 7) == len(t.encode("<|ENDOFTEXT|> <|endoftext|>", add_special_tokens=False).ids) + 1
    assert packing.pack_digest(docs.limit(0)).count() == 0
    clashing = packing.token_pieces(docs).selectExpr("*", "7 AS shard", "8 AS sequence_id", "9 AS piece_number")
    packed = packing.pack(clashing, 10)
    assert packed.count() == len(rows) and {r.shard for r in packed.collect()} == {7} and {r.piece_number for r in packed.collect()} == {9}


def test_equal_pieces_are_spread(spark):
    same = spark.range(400).selectExpr("1L AS doc_id", "0 AS piece", "0L AS start", "700L AS length")
    packed = packing.pack(same, 400, per_shard=50).collect()
    per_shard = Counter(r.sequence_id >> 32 for r in packed)
    assert len(packed) == 400 and len(per_shard) == 8 and max(per_shard.values()) < 100


def test_words_are_encoded_alike_while_generations_change():
    w = tokens.WordIds(packing.VOCABULARY, most=3)
    texts = ["a b c d e f a b", "A e f g H", "naïve CAFÉ It's", "a.b. c'd, don't. 'S! é.… x…. 9.! _a_ ª. ①. ²! <|endoftext|>. a<|endoftext|>.", "Ǆ. ﬁ, ß! İ. \u0301. a\u0301. \u0958.", "．. 。. ٣. १! a'. b'!' c.'s"] * 2
    assert [np.frombuffer(w.of(x), "<u4").tolist() for x in texts] == [w.tokenizer.encode(x, add_special_tokens=False).ids for x in texts]


# ---- names, long texts, empty tables ------------------------------------------------------------------------------


def test_columns_of_any_name_stay(spark):
    docs = docs_of(spark, [(1, "a b c d e f g"), (2, "a b c d e f g"), (None, None)])
    names = ["gone", "_gone", "block", "_block", "_bucket", "quality_score", "_quality_score", "shard", "key", "cluster", "set"]
    wide = docs.selectExpr("*", *(f"{i} AS `{n}`" for i, n in enumerate(names)))
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    for made in (neardup.keep_one(wide), substrings.remove_repeats(wide).drop("n_words", "n_removed"), quality.keep_good(wide, labels), secrets.redact_secrets(wide), quality.score(wide, quality.fit(wide, labels)).drop("score"), fingerprint.fingerprints(wide).drop("fingerprint")):
        rows = made.collect()
        assert made.columns == wide.columns and len(rows) in (2, 3) and all(r[n] == i for r in rows for i, n in enumerate(names))
    replaced = fingerprint.fingerprints(docs.selectExpr("*", "1 AS fingerprint"))
    assert replaced.columns[-1] == "fingerprint" and dict(replaced.dtypes)["fingerprint"] == "string"
    assert dict(quality.score(docs.selectExpr("*", "1 AS score"), quality.fit(docs, labels)).dtypes)["score"] == "double"


def test_very_long_texts(spark):
    text = " ".join(f"w{i % 5000} token=abcdef{i}" if i % 50 == 0 else f"w{i % 5000}" for i in range(400_000))
    docs = docs_of(spark, [(1, text), (2, "x" * 3_000_000)])
    assert {r.doc_id: r.n_assign for r in secrets.secret_digest(docs).collect()} == {1: 8000, 2: 0}
    assert {r.doc_id: r.n_chars for r in fingerprint.neighbour_digest(docs).collect()} == {1: len(text), 2: 3_000_000}
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in quality.quality_scores(docs, labels).collect())
    turns = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", "x" * 3_000_000)], "conv_id long, turn long, role string, text string")
    assert chat.chat_digest(turns).first().loss_chars == 3_000_000
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substrings.substring_digest(docs).collect()}
    assert got == {1: (len(text.split()), 0), 2: (1, 0)}


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from clauseframe.llm import common

    class Stub:
        class conf:
            get = staticmethod(lambda name, default: default)

        class sparkContext:
            master = "spark://elsewhere:7077"

    with pytest.raises(ValueError):
        common.shared_dir(Stub())


# ---- pipeline ------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [(r.doc_id, r.text) for r in docs.collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "substrings", "secrets", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = corpus_pipeline.written(stage(spark, docs, sf), name)
        assert now.columns == docs.columns
        rows = {r.doc_id: r for r in now.collect()}
        if name == "quality":
            assert set(rows) <= {i for i, _ in seen} and all(rows[i].text == t for i, t in seen if i in rows) and len(rows) > 0.8 * len(seen)
        elif name == "near_duplicates":
            assert set(rows) == {i for i, c in groups(seen).items() if i == c}
        elif name == "substrings":
            digests = {i: (n, d) for i, _, n, d in without_repeats(seen)}
            assert set(rows) == set(digests) and all(sha(" ".join(WORD.findall(r.text))) == digests[i][1] for i, r in rows.items())
            assert all(rows[i].text == t for i, t in seen if not digests[i][0])
        else:
            assert {i: r.text for i, r in rows.items()} == {i: secrets.redacted(t, secrets.find(t), "[SECRET]") for i, t in seen}
        assert all(r.n_chars == len(r.text) for r in rows.values())
        docs, seen = now, [(i, r.text) for i, r in rows.items()]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    t = tokens.load(packing.VOCABULARY)
    texts = {}
    for r in sorted(packed, key=lambda r: (r.doc_id, r.piece)):
        texts.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert texts == {i: [*t.encode(x, add_special_tokens=False).ids, 0] for i, x in seen}
    assert corpus_pipeline.run(spark, sf).count() == len(packed)


def test_pipeline_stages_of_awkward_rows(spark, sf):
    import corpus_pipeline

    rows = docs_of(spark, [*AWKWARD, (7, "word " * 3000), (8, "a b c d e f token=abcdef1"), (8, "a b c d e f token=abcdef1")]).selectExpr("*", "1 AS block", "2 AS gone", "3 AS shard")
    for docs in (rows, rows.limit(0)):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.written(stage(spark, docs, sf), name)
            assert docs.columns == rows.columns
            left = docs.count()
            assert left <= n and (left == n or name in ("quality", "near_duplicates"))
            n = left
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
        assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}
        assert sum(r.piece == 0 for r in packed) == n
