"""Analytics over tables and streams produced by fleets of RGB-D cameras."""
