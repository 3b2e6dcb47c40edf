"""Operators that also run on streaming DataFrames.

They work row by row, without shuffle or state, so ``df.transform(operator)``
is the same on a batch table and on ``spark.readStream``.
"""

from glossaria.operators.recode import add_column, filter_language, recode_language, same_language_rows, translation_prompt
from glossaria.operators.romanize import augment_romanized, romanize
from glossaria.operators.subwords import tokenize_corpus, unk_fraction

ROW_WISE = (
    add_column, filter_language, recode_language, same_language_rows, translation_prompt, augment_romanized, romanize,
    tokenize_corpus, unk_fraction,
)
