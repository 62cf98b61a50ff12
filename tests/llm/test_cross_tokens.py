"""Cross-tokenizer alignment against both tokenizers' own libraries and all pairs of byte ranges."""

import hashlib
from collections import Counter, defaultdict

import pytest

from cladewise.llm import cross_tokens
from cladewise.llm.queries import tokenizer_pair

ODD = [
    None, "", " ", "a", "  two  blanks ", "tab\tand\nlines\r\n", "it's <|endoftext|> here </s> <unk> <0x41>", "naïve ñandú über 漢字 🙂", "x" * 9000,
    "word " * 3000, " odd spaces\x1f  ", "1234 56,78.9 !!!", "a ▁ b", "nul \x00 in", "é ﬁ ½", "あ" * 700, "\n\n  \n x", "word " * 3000,
]


@pytest.fixture(scope="module")
def brute():
    import public_tokenizers as p
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(p.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    m = sentencepiece.SentencePieceProcessor(model_file=p.path("piece_bpe_32k.model"))
    # The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in plain)}

    def tokens(text):
        if not text:
            return [], []
        whole = (" " + text).encode()
        a = [(i, bytes(of[c] for c in t.id_to_token(i))) for i in t.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(s[3:-1], 16)]) if m.is_byte(i) else s.replace("▁", " ").encode()) for i in m.encode(text) for s in [m.id_to_piece(i)]]
        return (a, b) if whole == b"".join(x for _, x in a) == b"".join(x for _, x in b) else ([], [])

    def ranges(ids):
        out, at = [], 0
        for i, x in ids:
            out.append((i, at, at + len(x)))
            at += len(x)
        return out

    def report(rows):
        parts, held = [], Counter()
        for i, text in rows:
            a, b = map(ranges, tokens(text))
            cuts = sorted({e for *_, e in a} & {e for *_, e in b})
            where = {e: k for k, e in enumerate(cuts)}
            groups = []
            low = 0
            links = []
            groups = [[[], []] for _ in cuts]
            import bisect
            for side, ids in enumerate((a, b)):
                for x, _, e in ids:
                    groups[bisect.bisect_left(cuts, e)][side].append(x)
            for x, s, e in a:
                while low < len(b) and b[low][2] <= s:
                    low += 1
                k = low
                while k < len(b) and b[k][1] < e:
                    links.append((x, b[k][0]))
                    k += 1
            assert len(where) == len(groups)
            held.update(set(links))
            written = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
            parts.append((i, len(a), len(b), len(groups), links, hashlib.sha256(written.encode()).hexdigest() if a else ""))
        best = defaultdict(int)
        for (x, _), n in held.items():
            best[x] = max(best[x], n)
        return sorted(((i, na, nb, g, len(ls), sum(held[p] == best[p[0]] for p in ls), sum(held[p] for p in ls), d) for i, na, nb, g, ls, d in parts), key=repr)

    return report


def result(spark, rows, **settings):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, pair string, row int").repartition(3)
    return sorted((tuple(r) for r in cross_tokens.corpus_alignment(docs, *tokenizer_pair(), **settings).collect()), key=repr)


@pytest.mark.parametrize("sent", [1 << 20, 40, 1])
def test_odd_texts(spark, brute, sent):
    rows = [*enumerate(ODD), (None, "no id here"), (3, "a"), (3, "a")]
    assert result(spark, rows, most_sent=sent) == brute(rows)


def test_corpus(spark, sf_dir, brute):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert result(spark, rows) == brute(rows)


def test_windows_are_forgotten(brute, monkeypatch):
    monkeypatch.setattr(cross_tokens, "REMEMBERED", 4)
    both = cross_tokens.Aligner(*tokenizer_pair())
    for _ in range(3):
        for text in ODD:
            n_a, n_b, groups, links, written, pairs, times = both.documents([text, text])
            (_, a, b, g, n, _, _, digest), _ = brute([(0, text), (0, text)])
            assert (n_a[0], n_b[1], groups[0], links[1]) == (a, b, g, n)
            assert (hashlib.sha256(written[0].encode()).hexdigest() if written[0] else "") == digest
            assert sum(times[1].as_py()) == n


def test_empty_table(spark):
    assert result(spark, []) == []
