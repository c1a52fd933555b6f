"""Operations that a training-data pipeline runs over text tables of any size."""
