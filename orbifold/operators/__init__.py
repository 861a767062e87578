"""DataFrame operators: pairs, affinities, similarity loss, optimiser steps, samplers, metrics, projections."""
