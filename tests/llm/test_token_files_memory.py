"""What a worker keeps till its end, the tokenizer file and what hangs on it, is out of the garbage collector's way."""

import gc

from ledgerlight.llm import queries, wavelet


def test_the_encoder_is_frozen():
    gc.unfreeze()
    wavelet.encoder.cache_clear()
    wavelet.encoder(queries.BYTE_TOKENIZER)
    assert gc.get_freeze_count() > 0
