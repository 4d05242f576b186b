"""Speech-corpus jobs on Spark: manifests, augmentation plans, labels, scores and streams."""
