import random

import pytest

from chronofid.llm import token_counts

from .conftest import sentence


def slow_count(vocabulary, text):
    """Best segmentation of the whole text at once."""
    if not text:
        return 0
    s = token_counts.SPACE + text.replace(" ", token_counts.SPACE)
    best, tokens = [0.0], [0]
    for end in range(1, len(s) + 1):
        options = []
        for start in range(max(0, end - vocabulary.longest), end):
            score = vocabulary.scores.get(s[start:end])
            if score is not None:
                options.append((best[start] + score, -start, tokens[start] + 1))
            elif start == end - 1:
                options.append((best[start] + vocabulary.unknown, -start, tokens[start] + len(s[start].encode())))
        top = max(options)
        best.append(top[0])
        tokens.append(top[2])
    return tokens[-1]


@pytest.fixture(scope="module")
def vocabulary():
    draw = random.Random(3)
    pieces = {c: -9.0 - k for k, c in enumerate("abcdefgh▁")}
    for _ in range(300):
        piece = draw.choice(["", "▁"]) + "".join(draw.choices("abcdefgh", k=draw.randint(1, 6)))
        pieces.setdefault(piece, -float(draw.randint(1, 12)))
    pieces["▁▁"] = -3.0
    return token_counts.Vocabulary.of(pieces)


def test_equals_segmentation_of_whole_texts(spark, vocabulary):
    draw = random.Random(8)
    texts = [sentence(draw, draw.randint(1, 30), "abcdefghxé") for _ in range(60)]
    texts += ["  two  spaces ", "a\nb\n\n c", "\n", " ", "漢字 mixed\x01", "b" * 400, None, "", texts[0]]
    rows = list(enumerate(texts))
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary).collect()}
    assert got == {i: slow_count(vocabulary, t) for i, t in rows}


def test_memory_that_starts_anew_changes_nothing(vocabulary, monkeypatch):
    draw = random.Random(5)
    words = ["▁" + sentence(draw, 1) for _ in range(200)]
    whole, small = token_counts.Counter(vocabulary), token_counts.Counter(vocabulary)
    whole.learn(set(words))
    monkeypatch.setattr(token_counts, "MAX_KNOWN", 10)
    for k in range(0, 200, 20):
        small.learn(set(words[k : k + 20]))
        assert all(small.known[w] == whole.known[w] for w in words[k : k + 20])


def test_a_piece_across_pretokens_is_refused():
    with pytest.raises(ValueError):
        token_counts.Vocabulary.of({"a▁b": -1.0})


def test_equals_the_library_on_a_unigram_model():
    sentencepiece = pytest.importorskip("sentencepiece")
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    try:
        raw = open(token_counts.VOCABULARY, "rb").read()
    except OSError:
        pytest.skip("no vocabulary file here")
    proto = pb.ModelProto()
    proto.ParseFromString(raw)
    proto.trainer_spec.model_type = 1
    for p in proto.pieces:
        p.score = max(p.score, -32000.0)  # the library adds in 32 bits
    model = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    counter = token_counts.Counter(token_counts.Vocabulary.of({p.piece: p.score for p in proto.pieces if p.type == 1}))
    for text in ["Hello world", "The quick brown fox\njumps over  it.", "naïve café 漢字 \x01", "supercalifragilistic " * 20]:
        listed = token_counts.pretokens(text)
        counter.learn(set(listed))
        assert sum(counter.known[p] for p in listed) == len(model.encode(text))


def test_messy_and_empty(messy, messy_rows, nothing, vocabulary):
    got = token_counts.token_counts(messy, vocabulary).collect()
    assert len(got) == len(messy_rows)
    assert {r.n_tokens for r in got if r.doc_id in (30, 31)} == {0}
    assert token_counts.token_counts(nothing[0], vocabulary).count() == 0
