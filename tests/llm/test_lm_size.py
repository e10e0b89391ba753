import numpy as np

from sightline.llm import lm_score


def test_frequent_words_have_outputs_of_their_own_and_four_places():
    lexicon = lm_score.Lexicon([(2 * k + 1, k % lm_score.RARE, 1000 - k) for k in range(400)])
    assert len(set(lexicon.classes[:320].tolist())) == 320
    model = lm_score.Model(np.zeros(lm_score.CLASSES))
    assert len(model.contexts(np.arange(30), 0)[1]) == 4


def test_codes_are_those_of_a_dictionary():
    rng = np.random.default_rng(0)
    hashes = np.unique(rng.integers(0, 1 << 63, 3000, np.uint64))
    crowded = np.concatenate([hashes[:1500], (hashes[:1500] >> np.uint64(43) << np.uint64(43)) | np.uint64(5)])
    known = [(int(h), k % lm_score.RARE, 5) for k, h in enumerate(dict.fromkeys(crowded.tolist()))]
    lexicon, want = lm_score.Lexicon(known), {h: k for k, (h, *_) in enumerate(known)}
    asked = rng.permutation(np.concatenate([crowded, hashes[1500:]]))
    codes, rare = lexicon.encode(asked, np.full(len(asked), 7, np.int32))
    assert codes.tolist() == [want.get(h, len(known) + 7) for h in asked.tolist()]
    assert rare.tolist() == [h for h in asked.tolist() if h not in want]


def test_training_reads_encoded_texts(spark):
    """Groups are trained on from classes of tokens, made once, as a plain loop does in the order of hashes."""
    rng = np.random.default_rng(1)
    rows = sorted((int(h), rng.integers(0, lm_score.CLASSES, int(n)).astype(np.int16).tobytes()) for h, n in zip(rng.integers(-(1 << 62), 1 << 62, 40), rng.integers(1, 300, 40), strict=True))
    noise = np.full(lm_score.CLASSES, 1 / lm_score.CLASSES)
    start = spark.sparkContext.broadcast(lm_score.Model(np.log(noise)).flat())
    model = lm_score.Model.of(start.value.copy())
    trainer = lm_score.Trainer(model, noise, lm_score.MIX_RATE, 0)
    for _, ids in rows:
        trainer.text(np.frombuffer(ids, np.int16).astype(np.int64))
    trainer.flush()
    found = lm_score._mixed(spark.createDataFrame([(h, bytearray(x)) for h, x in rows], "h long, ids binary").repartition(5), start, noise, 0, 1)
    assert np.allclose(found.flat(), model.flat(), atol=1e-6)
