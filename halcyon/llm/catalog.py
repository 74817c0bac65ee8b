"""Import every operator module so that its query registers."""

from halcyon.llm import bpe, caps, fingerprint, html, infill, minhash, mixing, packing, passages, phrases, sharding, topk, toxicity  # noqa: F401
