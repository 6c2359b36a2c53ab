"""Speech-corpus curation as Spark jobs over tables of sources, segments, frames and phones."""
