from plinth.functions.hashing import fingerprint, fmix64, fnv1a64, partition_of

__all__ = ["fingerprint", "fmix64", "fnv1a64", "partition_of"]
