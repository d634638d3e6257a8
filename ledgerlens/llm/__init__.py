"""Training-data operators: decontamination, quality, language, near-dedup,
sharding, packing and token counts. Nothing else in the package imports this
subpackage; the entry module adds its queries when it is present."""
