"""The four end-to-end flows: prepare, explore, evaluate, augment."""
