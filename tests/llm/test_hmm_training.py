"""Operator 8: every training document shapes the states, whole and until the likelihood settles."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from stratalog.llm import hmm_scoring as hm

from .test_models import small_model


class Sent:
    def __init__(self, value):
        self.value = value


def test_cuts_carry_the_states_on():
    m, r = small_model(), np.random.default_rng(3)
    texts = [r.integers(0, 5, n) for n in (1, 2, 7, 7, 8, 9, 20)]
    whole = m.forward_backward(texts)
    assert whole[3] == pytest.approx(m.log10(texts).sum(), rel=1e-5)
    for piece in (1, 2, 3, 7, 19, 20, 50):
        for a, b in zip(m.forward_backward(texts, piece), whole, strict=True):
            assert np.allclose(a, b, rtol=1e-4, atol=1e-4)


def test_a_long_text_takes_the_steps_of_one_piece(monkeypatch):
    steps, columns = [], hm.Hmm._columns
    monkeypatch.setattr(hm.Hmm, "_columns", staticmethod(lambda texts: steps.append(max(map(len, texts))) or columns(texts)))
    m, text = small_model(), np.random.default_rng(5).integers(0, 5, 20_000)
    for work in (m.forward_backward, m.log10):
        steps.clear()
        work([text])
        assert sum(steps) <= hm.PIECE + 64
    log, a = 0.0, m.start * m.emit[:, text[0]]
    for x in text[1:]:
        log += math.log10(a.sum())
        a = a / a.sum() @ m.move * m.emit[:, x]
    assert m.log10([text, text[:3]])[0] == pytest.approx(log + math.log10(a.sum()), rel=1e-12)
    long = [text[:700], text[:64], text[:65], text[5:900]]
    for piece in (63, 64, 65, 130, 200):
        for a, b in zip(m.forward_backward(long, piece), m.forward_backward(long), strict=True):
            assert np.allclose(a, b, rtol=1e-4, atol=1e-3)


def test_steps_that_leave_the_floats_are_taken_one_by_one():
    x = 1e-17
    m = hm.Hmm(np.array([1 - x, x]), np.array([[1 - x, x], [x, 1 - x]]), np.array([[1 - x, x], [x, 1 - x]]))
    text = np.tile([0, 1], 40)
    starts, moves, emits, log = m.forward_backward([text])
    assert log == pytest.approx(m.log10([text])[0], rel=1e-5)
    assert emits.sum() == pytest.approx(80, rel=1e-3) and moves.sum() == pytest.approx(79, rel=1e-3)


def test_words_of_odd_texts():
    texts = ["The the\x0bTHE", None, "", " \x1c\u00a0 a\n", "\u00c9a\x85b \x0c"]
    size, number, words = hm.split_words(pa.array(texts))
    flat = [w for x in texts for w in (x or "").encode().lower().split()]
    assert size.tolist() == [len((x or "").encode().split()) for x in texts]
    assert [words[i].as_py() for i in number.tolist()] == flat


def test_a_long_text_starts_once_and_moves_at_every_token():
    n = 3 * hm.PIECE + 7
    raw = np.random.default_rng(4).integers(0, 5, n).astype("<u2")
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "symbols": [raw.tobytes()]})
    (out,) = hm._expect(Sent(small_model()))(iter([batch]))
    count = np.frombuffer(out.column("sums")[0].as_py())[:-1].reshape(3, -1)  # a row for each state: start, moves, emissions
    assert count[:, 0].sum() == pytest.approx(1, abs=1e-3)
    assert count[:, 1:4].sum() == pytest.approx(n - 1, rel=1e-4)


def test_all_rounds_see_all_documents_until_they_settle(spark):
    r, rows = np.random.default_rng(6), []
    for i in range(300):  # what tells the symbols apart lies behind the 4096th token
        late = np.tile([1, 2] if i % 2 else [3, 4], 200)
        rows.append((i, True, np.concatenate([np.zeros(4200 if i < 20 else 3, int), late, [0]]).astype("<u2").tobytes(), i % hm.TURNS))
    encoded = spark.createDataFrame([*rows, (999, False, r.integers(0, 5, 50).astype("<u2").tobytes(), 0)], "doc_id long, train boolean, symbols binary, turn int")
    share = np.full(5, 0.2)
    fresh = hm.Hmm.fresh(4, share)
    model = hm.train(encoded, fresh, share)
    again, log = hm.baum_welch(encoded, model, share)
    assert log > hm.baum_welch(encoded, fresh, share)[1]
    assert hm.baum_welch(encoded, again, share)[1] - log < 2 * hm.SETTLED * abs(log)
    texts = [np.frombuffer(x[2], "<u2") for x in rows]
    assert log == pytest.approx(model.log10(texts).sum(), rel=1e-4)


def test_parts_without_training_documents_change_nothing(spark):
    raw = np.array([1, 2, 1, 2, 0]).astype("<u2").tobytes()
    encoded = spark.createDataFrame([(1, False, raw, 0), (2, True, raw, hm.TURNS - 1)], "doc_id long, train boolean, symbols binary, turn int")
    share = np.full(5, 0.2)
    model = hm.train(encoded, hm.Hmm.fresh(4, share), share)
    assert np.ptp(model.move) > 0 and np.ptp(model.emit[:, 1]) > 0


def test_scores_are_those_of_the_fitted_model_by_hand(spark, monkeypatch):
    seen = {}
    fit, build = hm.train, hm.build_lexicon
    monkeypatch.setattr(hm, "train", lambda *a: seen.setdefault("model", fit(*a)))
    monkeypatch.setattr(hm, "build_lexicon", lambda *a: seen.setdefault("lexicon", build(*a)))
    monkeypatch.setattr(hm, "KNOWN_RATE", 30)  # so that many words go through the join
    monkeypatch.setattr(hm, "OWN_RATE", 20)
    monkeypatch.setattr(hm, "SETTLED", 1e-2)  # any fitted model will do
    r = np.random.default_rng(8)
    pool = [f"w{i}ing" for i in range(40)] + ["the", "of", "\u00e9"]
    rows = [(i, " ".join(pool[min(int(x), 42)] for x in r.exponential(9, int(r.integers(0, 30))))) for i in range(80)]
    rows += [(7, rows[7][1]), (None, "the of the"), (200, None), (201, "never seen before")]
    got = hm.score(spark.createDataFrame(rows, "doc_id long, text string"), states=3).collect()
    count = Counter(w for i, t in rows if hm.trains(i) for w in (t or "").encode().split())
    own = {w for w in count if count[w] * 20 >= seen["lexicon"].tokens}
    model, lex = seen["model"], seen["lexicon"]
    assert own and any(w not in lex.index for w in count)
    tokens, distinct = Counter(), Counter()
    for w in count.keys() - own:
        tokens[hm.word_class(w)] += count[w]
        distinct[hm.word_class(w)] += 1

    def by_hand(text):
        log, at = 0.0, []
        for w in (text or "").encode().split():
            c = hm.word_class(w)
            at.append(int(lex.symbol[lex.index[w]]) if w in own else c)
            if w not in own:
                log += math.log10((count[w] + 0.5) / (tokens[c] + 0.5 * (distinct[c] + 1)))
        at.append(lex.end)
        a = [float(s * e) for s, e in zip(model.start, model.emit[:, at[0]], strict=True)]
        for x in at[1:]:
            total = sum(a)
            log += math.log10(total)
            a = [sum(a[i] / total * model.move[i, j] for i in range(3)) * model.emit[j, x] for j in range(3)]
        return log + math.log10(sum(a))

    assert sorted((str(x.doc_id), round(x.score, 6)) for x in got) == sorted((str(i), round(by_hand(t), 6)) for i, t in rows)


def rounds_of(monkeypatch, texts, share, stretch):
    """Rounds until the likelihood settles, and what it is then."""
    calls = []

    class Parts:
        def where(self, turn):
            calls.append(turn)
            return texts[turn :: hm.TURNS]

    class Turn:
        def __eq__(self, turn):
            return turn

    monkeypatch.setattr(hm.F, "col", lambda name: Turn())
    monkeypatch.setattr(hm, "expectation", lambda some, model: model.forward_backward(some))
    monkeypatch.setattr(hm, "STRETCH", stretch)
    model = hm.train(Parts(), hm.Hmm.fresh(4, share), share)
    assert calls == list(range(hm.TURNS)) * (len(calls) // hm.TURNS)
    return len(calls) // hm.TURNS, model.log10(texts).sum()


def test_stretched_rounds_settle_sooner_and_no_lower(monkeypatch):
    r, texts = np.random.default_rng(11), []
    emit = r.dirichlet(np.full(30, 1.0), 4).cumsum(1)
    for _ in range(400):
        s, x = int(r.integers(4)), []
        for u, v in r.random((60, 2)):
            x.append(min(29, int(np.searchsorted(emit[s], u))))
            s = s if v <= 0.5 else int(r.integers(4))
        texts.append(np.array(x))
    share = np.bincount(np.concatenate(texts), minlength=30) / sum(map(len, texts))
    plain, stretched = (rounds_of(monkeypatch, texts, share, x) for x in (1.0, hm.STRETCH))
    assert stretched[0] < plain[0] and stretched[1] > plain[1]
    assert rounds_of(monkeypatch, texts, share, 30.0)[0] < 3 * plain[0]  # steps too far are taken back, and training ends


def test_stretched_counts_keep_their_totals():
    now, old = [np.array([4.0, 0.0, 12.0]), np.zeros((2, 2))], [np.array([8.0, 0.0, 6.0]), np.zeros((2, 2))]
    a, b = hm.stretched(now, old, 1.5)
    assert a.sum() == pytest.approx(16) and a[0] < 4 and a[1] == 0 and a[2] > 12 and not b.any()
