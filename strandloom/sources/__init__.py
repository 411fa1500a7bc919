"""Readers and writers: FASTQ, raw deliveries, node lines."""
