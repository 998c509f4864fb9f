"""Multi-step jobs: register, index, migrate, search by text."""
