"""Operations of a training-data pipeline, beside the annotation operators.

Nothing else in the library imports this subpackage.
"""
