"""The end of the audio signal reaches the features."""

import numpy as np

from pactlake.llm import audio


def test_every_sample_lies_in_a_frame():
    for n in (1, 256, 257, 345, 352, 353, 2000):
        mel, _ = audio.log_mel(np.zeros(n))
        assert (len(mel) - 1) * audio.HOP + audio.FRAME >= n > (len(mel) - 2) * audio.HOP + audio.FRAME or len(mel) == 1
    for n in (5, 576, 1152):
        x = np.zeros(n)
        x[-1] = 1.0
        assert np.isclose(audio.resample(x).sum(), audio.resample(np.eye(1, n + 60, n - 1)[0]).sum()) and audio.resample(x).any()


def test_texts_that_differ_at_the_end_have_other_features(spark):
    rows = [(0, "a" * 576), (1, "a" * 500 + "zq" * 38)]
    a, b = sorted(audio.audio_columns(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert a["payload_bytes"] == b["payload_bytes"] == 576
    assert a["feature"] != b["feature"]
