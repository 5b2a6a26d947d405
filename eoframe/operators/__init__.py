"""DataFrame operators over scenes, pixels, granules, versions and features."""
