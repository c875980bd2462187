"""Mergeable summaries: Bloom and cuckoo filters, count-min, top-k and quantile digests."""
