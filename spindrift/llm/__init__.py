"""Operations on training data. Nothing outside this package imports it."""
